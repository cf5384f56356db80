"""The pipeline's stages against brute force on small tables."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylight.llm import decontam, queries, simhash, toxicity
from tests.llm.test_llm import brute_fingerprint, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rng = random.Random(8)
    item = " ".join(words(rng, 30))
    rows = []
    for i in range(160):
        text = "\n".join(" ".join(words(rng, 15)) for _ in range(4))
        if i % 5 == 0:
            text += "\nyou pathetic moron go away now"
        if i % 7 == 0:
            text += " " + item + " end"
        if i % 3 == 0:
            text += "\nShared line of every third document"
        rows.append((i, text))
    rows += [(200, rows[1][1]), (201, rows[1][1]), (202, None), (203, "")]
    full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "other words that nobody has used in any text")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return f"{d}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    state = {r.doc_id: r.text for r in docs.collect()}
    state = {i: t for i, t in state.items() if model.score(model.marginals([t])[0]) < 0.3}
    assert not any(i % 5 == 0 for i in state if i < 160) and sum(i < 160 for i in state) == 128

    seen, new = set(), {}
    for i in sorted(state):
        keep = []
        for x in (state[i] or "").split("\n"):
            k = x.strip().lower()
            if len(k) < 10 or (k, 0) not in seen:
                keep.append(x)
        seen |= {(x.strip().lower(), 0) for x in (state[i] or "").split("\n")}
        new[i] = "\n".join(keep)
    groups: dict[int, int] = {}
    prints = {i: brute_fingerprint(t, 5) for i, t in new.items()}
    for i in sorted(prints):
        groups[i] = next((groups[j] for j in sorted(groups) if (prints[i] ^ prints[j]).bit_count() <= 4), i)
    kept = {i: t for i, t in new.items() if groups[i] == i}
    bench = decontam.Matcher([(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()], decontam.RATE, decontam.MIN_WORDS)
    clean = {i: t for i, t in kept.items() if not bench.find(t)}
    assert len(clean) < len(kept) < len(new)

    current = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, (state, new, kept, clean)):
        current = stage(spark, current, folder)
        assert current.columns == COLUMNS, name
        got = {r.doc_id: r.text for r in current.collect()}
        assert got == want, name
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == set(clean)
    for i in clean:
        own = sorted((r.start, r.length, r.doc_tokens) for r in pieces if r.doc_id == i)
        assert sum(n for _, n, _ in own) == own[0][2]


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0, name


def test_odd_rows_and_empty_labels_and_benchmark(spark, folder, tmp_path):
    """Null and repeated ids, long texts, extra columns; nothing to learn from."""
    spark.read.parquet(f"{folder}/labels.parquet").filter("false").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").filter("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(5)
    texts = [" ".join(words(rng, 40, 9000)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[0]), (None, texts[2]), (None, texts[2]), (None, None), (3, None), (4, ""), (5, " ".join(words(rng, 20_000, 9000))), (6, texts[3])]
    full = [(i, t, None, "s", None, "own", 1) for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row string, item_id int").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*COLUMNS, "row", "item_id"], name
    got = sorted(((r.doc_id or 0, r.text) for r in docs.collect()), key=str)
    assert got == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2]), (0, texts[2]), (0, ""), (2, ""), (5, rows[9][1]), (6, texts[3])], key=str)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len({(r.doc_id, r.start, r.ids_crc32) for r in pieces}) > 20 and {r.doc_id for r in pieces} == {1, 2, 5, 6, None}


def test_registered():
    for n in range(1, 11):
        assert any(q.startswith(f"op{n}_") for q in queries.QUERIES)
    assert corpus_pipeline.ORACLE_SQL is None and zlib.crc32(b"1") % 4 == 3


@pytest.mark.parametrize("tile", [1024, 4])
def test_near_copies_with_scattered_edits(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng, rows = random.Random(3), []
    for base in range(40):
        text = words(rng, 240, 5000)
        for k in range(rng.choice([1, 2, 24])):
            own = list(text)
            for _ in range(k % 6):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(own)))
    rows += [(500, ""), (501, None), (502, "one two"), (503, "One  two"), (504, rows[3][1]), (504, rows[3][1]), (505, "some text"), (505, "of the same id"), (None, "one two"), (None, None)]
    sets = {(i, t): {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    link = {x: {y for y in sets if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])} for x in sets}
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.dedup_near(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) and {x for x in kept if x[0] is None} == {(None, "one two"), (None, None)}
    own = {x for x in kept if x[0] is not None}
    # No document goes without a near copy that stays or led to one, and those
    # of one group that stay are few: pairs at 0.8 itself may be missed.
    groups, seen = [], set()
    for x in sorted((x for x in sets if x[0] is not None), key=lambda x: (x[0], x[1] or "")):
        if x not in seen:
            group, todo = {x}, [x]
            while todo:
                new = link[todo.pop()] - group
                group |= new
                todo += new
            seen |= group
            groups.append((x, group))
    assert all(x in own for x, _ in groups)
    extra = len(own) - len(groups)
    assert extra <= 0.1 * (len(sets) - len(groups)) and len(groups) < 60 < len(rows)


def brute_groups(sets):
    """The least index of the component of each set, by links at 0.8."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(sets))]


@pytest.mark.parametrize("tile", [1024, 50])
def test_sets_near_the_limit_in_one_bucket(spark, monkeypatch, tile):
    """Whatever shares a bucket and is no further apart than ``distances`` says is
    linked, however the first comparisons leave the bucket divided."""
    rng, texts = random.Random(9), []
    for _ in range(60):
        base = words(rng, 240, 9000)
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randrange(3, 6)):
                own[rng.randrange(len(own))] = f"y{rng.random()}"
            texts.append(" ".join(own))

    def one_bucket(distinct, radius):
        members = distinct.select(F.lit(1).cast("long").alias("bucket"), "uid")
        return members, members.groupBy("bucket").agg(F.min("uid").alias("first"), F.count("*").alias("size"))

    monkeypatch.setattr(simhash, "shared_buckets", one_bucket)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_copies(docs, tile=tile).collect()}
    sets = [{tuple(w[p : p + 5]) for p in range(len(w) - 4)} for w in map(str.split, texts)]
    groups = brute_groups(sets)
    assert len(set(groups)) > 70  # some bases come out divided
    assert kept <= {i for i, g in enumerate(groups) if i == g} and len(kept) >= 0.97 * len(set(groups))


def test_many_edits_of_one_text(spark):
    """Thousands of copies with a word changed in each: no crowded bucket is
    compared pair by pair."""
    rng = random.Random(4)
    base, rows = words(rng, 400, 9000), []
    for k in range(3000):
        own = list(base)
        own[k % 400] = f"z{k}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert [r.doc_id for r in simhash.near_copies(docs).collect()] == [0]
