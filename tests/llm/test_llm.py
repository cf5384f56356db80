"""The corpus operators against brute force, on small fixtures with nulls,
empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylight.llm import decontam, licenses, lines, packing, quality, simhash, substrings, toxicity, urls, warc
from quarrylight.llm.common import scratch_path

SCHEMA = "doc_id long, text string, h1 long, doc long, kept string"


def words(rng, n, size=400):
    return [f"w{int(size * rng.random() ** 2)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage, line = " ".join(words(rng, 20)), "A common line of some length"
    out = {}
    for i in range(40):
        own = "\n".join(" ".join(words(rng, rng.randrange(1, 40))) for _ in range(4))
        if i % 3 == 0:
            own += " " + passage + " tail"
        if i % 4 == 0:
            own += "\n  " + line.upper() + "\t\n" + line
        out[i + 1] = own
    out |= {50: out[2], 51: out[2], 52: "", 53: None, 54: " \n\t ", 55: "Same. " * 300, 56: "x", 57: "x", 58: " ".join(words(rng, 30_000)), 59: "Same. " * 200}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 1, 2, "c") for i, t in texts.items()] + [(3, texts[3], 9, 9, "d"), (None, texts[4], 0, 0, None), (None, None, 0, 0, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_lines(docs, empty, texts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    owner = {}
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            owner[key(x)] = min(owner.get(key(x), i), i)
    holders = collections.Counter(k for t in texts.values() for k in {key(x) for x in (t or "").split("\n")})
    for salts in (1, 64):
        for r in lines.deduplicate_lines(docs, salts=salts).filter("doc_id IS NOT NULL").collect():
            old = (texts[r.doc_id] or "").split("\n")
            new = [x for x in old if len(key(x)) < 10 or holders[key(x)] < 2 or owner[key(x)] == r.doc_id]
            assert (r.ql_n_lines, r.ql_n_dropped, r.text) == (len(old), len(old) - len(new), "\n".join(new)), r.doc_id
    nulls = lines.deduplicate_lines(docs).filter("doc_id IS NULL").collect()
    assert [r.ql_n_dropped for r in nulls] == [0, 0]
    assert lines.deduplicate_lines(empty).count() == 0 and lines.keep_bitmaps(empty).count() == 0


def brute_fingerprint(t, width=4):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty, texts):
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = simhash.near_duplicates(docs)
    rows = got.filter("doc_id IS NOT NULL").collect()
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in rows} == {(i, fp[i], find(i)) for i in fp}
    assert sorted(r.component_id for r in got.filter("doc_id IS NULL").collect()) == sorted([find(4), find(52)])
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bucket", [2048, 5])
def test_links_in_small_and_crowded_buckets(spark, bucket):
    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(3)]
    xs = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for c in centre for _ in range(25)})
    df = spark.createDataFrame([(simhash.signed(x), [simhash.signed(x)]) for x in xs], "uid long, fp array<long>")
    found = simhash.near_links(df, 4, 4, bucket)
    got = {r.node % 2**64: r.root for r in simhash.components(found).collect()}
    assert all((r.a % 2**64 ^ r.b % 2**64).bit_count() == r.distance <= 4 for r in found.collect())
    group = {x: {x} for x in xs}
    for x in xs:
        for y in xs:
            if (x ^ y).bit_count() <= 4 and group[x] is not group[y]:
                group[x] |= group[y]
                for z in group[x]:
                    group[z] = group[x]
    for x in xs:
        for y in xs:
            if x < y and len(group[x]) > 1 and len(group[y]) > 1:
                assert (got[x] == got[y]) == (group[x] is group[y])
    assert set(got) == {x for x in xs if len(group[x]) > 1}


def test_spanning_links_keep_what_every_distance_links():
    rng = np.random.default_rng(5)
    fps = np.repeat(rng.integers(0, 2**63, (4, 2)).astype(np.uint64), 12, axis=0)
    for k, row in enumerate(fps):
        for _ in range(k % 12):
            row[rng.integers(2)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    full = np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(axis=2)
    i, j, d = simhash.spanning_links(fps, 20)
    assert (full[i, j] == d).all() and len(i) < len(fps)

    def groups(edges):
        root = list(range(len(fps)))
        for a, b in edges:
            root = [root[a] if r == root[b] else r for r in root]
        return root

    for most in range(21):
        whole, some = groups(zip(*np.nonzero(full <= most))), groups((a, b) for a, b, x in zip(i, j, d) if x <= most)
        assert len(set(zip(whole, some))) == len(set(whole)) == len(set(some))


def test_covering_masks_cover():
    rng = random.Random(2)
    for seed in range(20, 27):
        masks = simhash.covering_masks(4, seed)
        assert len(masks) == 31
        for _ in range(500):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)


def test_substrings(docs, empty, texts):
    first = {}
    for i in sorted(texts):
        w = (texts[i] or "").split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for keep in ("text", "sha256"):
        for r in substrings.remove_repeats(docs, keep=keep).filter("doc_id IS NOT NULL").collect():
            w = (texts[r.doc_id] or "").split()
            gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < r.doc_id for q in range(p, p + 13)}
            left = " ".join(x for q, x in enumerate(w) if q not in gone)
            assert (r.n_words, r.n_removed) == (len(w), len(gone)), r.doc_id
            assert r.kept == (left if keep == "text" else hashlib.sha256(left.encode()).hexdigest())
            assert {q for s in r.spans for q in range(s.start, s.end)} == gone
    assert [r.n_removed for r in substrings.remove_repeats(docs).filter("doc_id IS NULL").collect()] == [0, 0]
    assert substrings.remove_repeats(empty).count() == 0


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    vocab = rng.integers(1, 2**63, 30).astype(np.uint64)
    names = vocab[(rng.random(4000) ** 2 * 30).astype(int)]
    names[100:140] = vocab[0]
    part = names[500:560]
    names[3000:3060] = part
    docs = np.repeat(np.arange(40), 100)
    keys, seen = substrings.anchors(names, docs), {}
    for p in range(len(names) - 12):
        inside = docs[p] == docs[p + 12]
        assert (keys[p] > 0) == inside
        if inside:
            assert seen.setdefault(names[p : p + 13].tobytes(), keys[p]) == keys[p]


@pytest.mark.parametrize("windows,fan_in", [(32, 32), (2, 2)])
def test_packing(docs, empty, texts, windows, fan_in):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_tokenizer())
    rows = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(7, "doc_id")
    want = {i: [*slow.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    parts, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(rows, windows=windows, fan_in=fan_in).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        parts[r.doc_id].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, w in want.items():
        done = []
        for start, ids in sorted(parts[i]):
            assert start == len(done)
            done += ids
        assert done == w
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 1024 - at
    assert padding < 1024
    assert packing.pack(empty).count() == 0


def test_fast_encoder_agrees():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())
    for t in ("", " ", "a<|endoftext|>b", "<|endoftext|>", "\r\n\t x", "It's 12,5° — naïve 東京 🙂", "  x", "ÀÉ" * 50, "'S 'Re don'T"):
        assert fast(t) == slow.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" ", "\n", "\u3000", " \t", "a", "7", "!", "é"])
def test_encoder_on_very_long_runs(run):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())
    for text in (run * 5000, f"x{run * 5000}y", f"{run * 4096} {run * 5000}\n\nb  c"):
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids
    assert len(fast("a" + run * 2_000_000 + "b")) > 1000


def edit_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_decontamination(spark, empty):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, rng.randrange(6, 40), 60))) for i in range(12)] + [(98, ""), (99, None), (97, "too short"), (0, "w1 w2 w3 w4 w5 w6 w7")]
    rows = []
    for d in range(60):
        w = words(rng, 60, 60)
        if d % 2:
            item = decontam.words(items[d % 12][1])
            for _ in range(rng.randrange(0, 6)):
                p = rng.randrange(len(item))
                item = item[:p] + rng.choice([[], [item[p], "zz"], ["qq"]]) + item[p + 1 :]
            w = w[:20] + item + w[20:]
        rows.append((d, " ".join(w).upper() + "!"))
    rows += [(100, None), (101, ""), (None, items[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter()
    for d, t in rows:
        for i, x in items:
            a = decontam.words(x)
            if len(a) >= 5 and (n := edit_distance(a, decontam.words(t))) <= int(0.2 * len(a)):
                want[d, i, n] += 1
    for size in (1 << 20, 50):
        got = collections.Counter((r.doc_id, r.item_id, r.distance) for r in decontam.find_items(docs, bench, block_chars=size).collect())
        assert got == want and len(want) > 10
    dirty = {d for d, *_ in want}
    assert {r.doc_id for r in decontam.keep_clean(docs, bench).collect()} == {d for d, _ in rows} - dirty
    assert decontam.find_items(empty, bench).count() == 0 and decontam.find_items(docs, bench.filter("false")).count() == 0


def test_myers_against_dynamic_programming():
    rng = random.Random(4)
    for _ in range(300):
        a, b = [rng.choice("abc") for _ in range(rng.randrange(1, 70))], [rng.choice("abc") for _ in range(rng.randrange(0, 80))]
        assert decontam.myers(a, b)[0] == edit_distance(a, b)


def test_quality(docs, empty, texts):
    for r in quality.judge(docs).filter("doc_id IS NOT NULL").collect():
        t = texts[r.doc_id] or ""
        w = t.encode().split()
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {q for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for q in range(i, i + 5)}
        real = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(real) - len(set(real)), len(covered)), r.doc_id
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and r.kept == (not r.base_failed and r.band_kept)
    verdict = quality.Judge()
    rng = random.Random(1)
    prose = " ".join(f"{rng.choice(['the', 'a', 'some', 'every'])} {''.join(rng.choice('etaoinshrdlu') for _ in range(rng.randrange(2, 9)))}" for _ in range(2000))
    assert verdict(prose)[-1] and verdict(prose[:60])[-1] and not verdict("spam eggs " * 500)[-1]
    noise = "".join(chr(rng.randrange(33, 0x2FFF)) for _ in range(6000))
    assert not verdict(noise)[-1] and not verdict(prose[:8192] + "ab" * 6000)[-1] and verdict(None)[0] is None
    assert quality.judge(empty).count() == 0


def test_quality_of_tails():
    verdict, rng = quality.Judge(), random.Random(2)
    prose = " ".join(f"{rng.choice(['the', 'a', 'some', 'every'])} {''.join(rng.choice('etaoinshrdlu') for _ in range(rng.randrange(2, 9)))}" for _ in range(800))[:4096]
    noise = "".join(chr(rng.randrange(33, 127)) for _ in range(3904))
    ratio, *_, outside, kept = verdict(prose + noise)
    low, high = quality.limits(8000)
    assert low <= ratio <= high and outside == 1 and not kept
    assert not verdict(noise + prose)[-1] and verdict((prose * 2)[:7000].swapcase()[:4096] + prose[:1000])[-1]


def test_toxicity():
    rng = random.Random(6)

    def make(bad):
        rows = [words(rng, 12) for _ in range(4)]
        if bad:
            rows[1].insert(rng.randrange(13), "moron")
        return "\n".join(map(" ".join, rows))

    rows = [(make(i % 4 == 0), int(i % 4 == 0)) for i in range(240)]
    model = toxicity.fit(rows)
    for bad in (True, False):
        found = model.marginals([make(bad), "", None])
        assert (model.score(found[0]) >= toxicity.THRESHOLD) == bad and model.score(found[1]) < toxicity.THRESHOLD
    text = "W1 w2\nw5 w6 Moron, w7 w8"
    spans = model.spans(model.marginals([text])[0])
    assert [text[s["start"] : s["end"]] for s in spans] == ["Moron"]
    assert toxicity.fit([]).score([]) < 0.3 and toxicity.fit([("a", 1)]).score([]) > 0.5


def test_chain_against_enumeration():
    rng = np.random.default_rng(0)
    emit, trans, start = rng.normal(size=7), rng.normal(size=(2, 2)), rng.normal(size=2)
    marg, pairs, starts, logz = toxicity.chain(emit, np.array([4, 3]), trans, start)
    total, want, count = 0.0, np.zeros(7), np.zeros((2, 2))
    for a, z in ((0, 4), (4, 7)):
        weights, part, moves = 0.0, np.zeros(z - a), np.zeros((2, 2))
        for code in range(2 ** (z - a)):
            y = [code >> k & 1 for k in range(z - a)]
            s = np.exp(start[y[0]] + sum(emit[a + k] for k in range(z - a) if y[k]) + sum(trans[p, q] for p, q in zip(y, y[1:])))
            weights += s
            part += s * np.array(y)
            for p, q in zip(y, y[1:]):
                moves[p, q] += s
        want[a:z], count, total = part / weights, count + moves / weights, total + np.log(weights)
    assert np.allclose(marg, want) and np.allclose(pairs, count) and np.isclose(logz, total) and np.isclose(starts.sum(), 2)


def test_toxicity_frame(spark, docs, empty):
    model = toxicity.fit([])
    assert toxicity.score_documents(docs, model).count() == docs.count() and toxicity.score_documents(empty, model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns and toxicity.keep_clean(docs, model).count() == docs.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels)
    assert 0 < len(rows) < 60 and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(60) if held(spark, i))


def test_toxicity_sample_leaves_out_long_rows_only(spark):
    docs = spark.createDataFrame([(i, "x" * (5000 if i < 2 else 10) + str(i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    some, every = toxicity.training_rows(docs, labels, chars=3000), toxicity.training_rows(docs, labels)
    assert sorted(some) == sorted(r for r in every if len(r[0]) < 5000) and {y for _, y in some} == {0, 1}


def test_toxic_words_come_first_in_the_vocabulary(monkeypatch):
    monkeypatch.setattr(toxicity, "VOCABULARY", 4)
    rng = random.Random(6)
    rows = [(" ".join(words(rng, 12) + ["zzmoron"] * (i % 4 == 0) + words(rng, 3)), int(i % 4 == 0)) for i in range(240)]
    model = toxicity.fit(rows)
    assert model.own.get("zzmoron", 0) > 0


def held(spark, i):
    return spark.range(1).select(toxicity.held_out(F.lit(i))).first()[0]


def test_licenses(docs, empty):
    model = licenses.Classifier()
    assert model("Released under the MIT License.")[0] == "MIT"
    assert model("This work is licensed under the GNU General Public License, version 3.")[0] == "GPL"
    assert model(licenses.TEXTS["BSD"][0].lower())[0] == "BSD"
    for text in (*licenses.DECOYS[3:8], "", "plain words of no kind", "."):
        hit = model(text)
        assert hit is None or hit[2] < licenses.SIMILARITY
    assert list(licenses.paragraphs("a\nb\n\nc")) == [(0, 1), (2, 3), (0, 3), (5, 6)] and list(licenses.paragraphs("")) == []
    out = licenses.scan(docs)
    assert out.count() == docs.count() and out.filter("size(findings) > 0").count() == 0 and licenses.scan(empty).count() == 0


def test_licenses_in_long_blocks_and_beside_notices():
    model = licenses.Classifier()
    wrapped = lambda text, n: "\n".join(" ".join(w[i : i + n]) for w in [text.split()] for i in range(0, len(w), n))
    gpl = wrapped(licenses.TEXTS["GPL"][0], 4)
    plain = "\n".join(f"the river ran past house {i} and on" for i in range(60))
    for text in (f"{plain}\n{gpl}", f"{plain}\n{gpl}\n", f"{gpl}\n{plain}", f"{plain}\n{gpl}\n{plain}\n\nend"):
        assert {f["family"] for f in licenses.find(text, model)} == {"GPL"}, text
    text = f"SPDX-License-Identifier: MIT\n{gpl}"
    assert {f["family"] for f in licenses.find(text, model)} == {"MIT", "GPL"}
    for n in (41, 60, 61, 100):
        assert {i for a, z in licenses.stretches(0, n) for i in range(a, z)} == set(range(n))


def test_url_rules_and_model(spark):
    rows = [(1, "https://A.Example.NET/en/x?q"), (2, "http://b.net/"), (3, "https://example.com/de/1#t"), (4, "https://x.org/fr/"), (5, None), (6, "no scheme"), (7, "https://casino-win.example.com/en/"), (8, "https://city-museum.example.com/en/"), (9, "ftp://É.com?x"), (9, "ftp://É.com?x")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2].rule, got[2].verdict, got[3].rule, got[3].verdict, got[4].rule) == ("net/", "block", "example.com/de/", "block", "org/fr/")
    assert (got[5].host, got[5].path, got[5].rule) == ("", "", None) and got[6].host == "" and got[9].host == "É.com"
    assert got[7].llr < got[8].llr and got[7].verdict == "block"
    assert len(got) == len({r[0] for r in rows})


def test_url_scores_read_domain_query_and_fragment(spark):
    rows = [(1, "http://casino-win.com/"), (2, "http://city-museum.com/"), (3, "http://a.org/?q=casino-bonus"), (4, "http://a.org/?q=museum-library"), (5, "http://a.org/#casino-bonus"), (6, "http://a.org/#museum-library"), (7, "http://a.org/")]
    got = {r.page_id: r.llr for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] < got[2] and got[3] < got[7] and got[3] < got[4] and got[5] < got[6]


def test_url_models_keep_all_grams_that_are_seen_often(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(4000)]
    rows = [(t, i % 2 == 0) for i, t in enumerate(texts) for _ in range(4)]
    grams = {p[i - k + 1 : i + 1] for t in texts for p in [f"^^^^{t}$"] for i in range(4, len(p)) for k in range(1, 6)}
    model = urls.fit(spark.createDataFrame(rows, "text string, accepted boolean"))
    assert len(grams) > 60_000 and {r.gram for r in model.collect()} == grams


def test_url_scores_do_not_depend_on_the_groups(spark, monkeypatch):
    model = spark.createDataFrame([("a", 0.5), ("b", -1.0), ("ab", 0.25)], "gram string, delta double")
    rows = spark.createDataFrame([(i, "ab" * (i % 5)) for i in range(50)], "i long, text string")
    for group in (4096, 3):
        monkeypatch.setattr(urls, "GROUP", group)
        got = {r.i: r.llr for r in urls.score(rows, model, ["i"]).collect()}
        assert got == {i: pytest.approx(-0.25 * (i % 5) / (2 * (i % 5) + 1)) for i in range(50)}


def test_lines_of_a_very_long_text(spark):
    """100,000 runs of kept and dropped lines in one text, in time that grows with
    their number."""
    n = 100_000
    rows = [(1, "\n".join(f"shared line {i}" for i in range(0, n, 2))), (2, "\n".join(f"shared line {i}" if i % 2 == 0 else f"own line number {i}" for i in range(n)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lines.deduplicate_lines(docs).collect()}
    assert got[1].text == rows[0][1] and got[2].ql_n_dropped == n // 2
    assert got[2].text == "\n".join(f"own line number {i}" for i in range(1, n, 2))


def test_warc_round_trip(spark):
    warc.register(spark)
    big = "ä" * 300_000
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, None), (4, "u\r\nx: y", ""), (5, "http://c", big), (6, "http://d", "GET\r\n\r\nWARC/1.1\r\n"), (None, "http://e", "same"), (7, "http://f", "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.revisit_records(pages).write.format("warc").mode("append").option("maxArchiveBytes", "2000").save(path)
    read = spark.read.format("warc").load(path)
    got = {r.record_id.removeprefix("urn:page:"): r for r in read.collect()}
    assert len(got) == 8 and got["1"].record_type == "response" and got["3"].refers_to == "urn:page:1" and got["none"].record_type == "revisit"
    assert got["4"].refers_to == "urn:page:2" and got["5"].payload == big.encode() and got["6"].payload == b"GET\r\n\r\nWARC/1.1\r\n"
    for r in got.values():
        if r.record_type == "response":
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode() and r.payload_length == len(r.payload)
    some = spark.read.format("warc").option("payload", "false").load(path).filter((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://a"))
    assert [r.record_id for r in some.collect()] == ["urn:page:3"]
    assert spark.read.format("warc").option("payload", "false").load(path).filter("payload IS NOT NULL").count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    record = lambda k, kind, body: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{k}>\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    data = [record(1, "warcinfo", b"software: x"), record(2, "response", b"HTTP/1.1 404 No\r\nContent-Type: text/plain\r\n\r\n" + b"z" * 100_000), record(3, "request", b"GET / HTTP/1.1\r\n\r\n")]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(d) for d in data))
    warc.register(spark)
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    assert sorted((r.archive, r.record_type) for r in rows) == sorted((a, t) for a in ("a.warc", "b.warc.gz") for t in ("warcinfo", "response", "request"))
    assert {(r.http_status, len(r.payload)) for r in rows if r.record_type == "response"} == {(404, 100_000)}


def test_warc_of_own_and_other_writers_in_one_folder(spark, tmp_path):
    import gzip

    warc.register(spark)
    record = lambda k: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{k}>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n".encode()
    (tmp_path / "other-1.warc.gz").write_bytes(gzip.compress(record("x1")))
    (tmp_path / "part-7.warc").write_bytes(record("x2"))
    pages = spark.createDataFrame([(1, "http://a", "one"), (2, "http://b", "two")], "page_id long, url string, html string")
    for _ in range(2):
        warc.revisit_records(pages).write.format("warc").mode("append").save(str(tmp_path))
    ids = lambda: sorted(r.record_id for r in spark.read.format("warc").load(str(tmp_path)).select("record_id").collect())
    want = sorted(["urn:x1", "urn:x2", *["urn:page:1", "urn:page:2"] * 2])
    assert ids() == want
    # What an attempt of a finished write has left does not count.
    job = next(f.name for f in tmp_path.iterdir() if f.name.startswith("_manifest-"))[10:-5]
    (tmp_path / f"part-{job}-{'0' * 32}.warc.gz").write_bytes(gzip.compress(record("lost")))
    assert ids() == want
    (tmp_path / f"part-{'1' * 32}-{'0' * 32}.warc.gz").write_bytes(gzip.compress(record("unknown")))
    with pytest.raises(Exception, match="without a manifest"):
        ids()


@pytest.mark.parametrize("head", [10, 20_000, 300_000])
def test_warc_members_of_several_records_and_long_http_headers(spark, tmp_path, head):
    import gzip

    def record(k, kind, body):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{k}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX-Long: " + random.Random(1).randbytes(head).hex().encode() + b"\r\n\r\n"
    data = [record(k, "response" if k % 2 else "request", (http if k % 2 else b"GET / HTTP/1.1\r\n\r\n") + b"z" * (4 + k)) for k in range(5)]
    whole = b"".join(data)
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole))
    cut = len(whole) // 2
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(whole[:cut]) + gzip.compress(whole[cut:]))
    (tmp_path / "d.warc.gz").write_bytes(warc.gzip_member(b"".join(data[:3])) + b"".join(map(warc.gzip_member, data[3:])))
    (tmp_path / "e.warc.gz").write_bytes(b"")
    warc.register(spark)
    for payload in ("true", "false"):
        read = spark.read.format("warc").option("payload", payload).load(str(tmp_path))
        rows = read.collect()
        assert sorted((r.archive, r.record_id) for r in rows) == [(a, f"urn:{k}") for a in ("a.warc", "b.warc.gz", "c.warc.gz", "d.warc.gz") for k in range(5)]
        for r in rows:
            k = int(r.record_id[4:])
            if k % 2:
                assert (r.http_status, r.payload_length, r.payload) == (200, 4 + k, b"z" * (4 + k) if payload == "true" else None)
        some = read.filter("record_type = 'request' AND record_id = 'urn:4'").collect()
        assert sorted(r.archive for r in some) == ["a.warc", "b.warc.gz", "c.warc.gz", "d.warc.gz"]


def test_warc_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", "same", 5, "x"), (1, "u", "same", 6, "y"), (2, "v", "same", 7, "z"), (3, "w", "other", 8, "q"), (None, "n", None, 9, "r"), (None, "n", None, 9, "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id long, sha string").withColumn("salt", F.lit(1)).withColumn("payload", F.lit("p"))
    got = sorted((r.record_id, r.record_type, r.refers_to or "") for r in warc.revisit_records(pages).collect())
    assert got == [("urn:page:1", "response", ""), ("urn:page:1", "response", ""), ("urn:page:2", "revisit", "urn:page:1"), ("urn:page:3", "response", ""), ("urn:page:none", "response", ""), ("urn:page:none", "response", "")]
    assert warc.revisit_records(pages.filter("false")).count() == 0


def brute_deltas(rows, order=5, least=4, tau=4.0):
    """gram -> what it adds to the log ratio, straight from the definition."""
    def line(t):
        t = re.sub(r"[^a-z0/.\-_~%?#&=+:]", "x", re.sub("[0-9]+", "0", t.lower()))
        return "^" * (order - 1) + t + "$"

    def grams(t):
        p = line(t)
        return [p[i - k + 1 : i + 1] for i in range(order - 1, len(p)) for k in range(1, order + 1)]

    counts = [collections.Counter(g for t, y in rows if y == want for g in grams(t)) for want in (True, False)]
    known = {g for g in counts[0] | counts[1] if counts[0][g] + counts[1][g] >= least}
    context = [collections.Counter() for _ in counts]
    for g in known:
        for c, n in zip(context, counts):
            c[g[:-1]] += n[g]

    def ratio(parts):
        p = [1 / 64, 1 / 64]
        for part in parts:
            p = [(n[part] + tau * q) / (c[part[:-1]] + tau) for n, c, q in zip(counts, context, p)]
        return math.log(p[0]) - math.log(p[1])

    suffixes = {g: [g[-k:] for k in range(1, len(g) + 1)] for g in known}
    return {g: ratio(s) - ratio(s[:-1]) for g, s in suffixes.items()}, grams, line


def test_url_ratio_and_limit_against_brute_force(spark):
    rng = random.Random(4)
    pick = lambda xs: "-".join(rng.choice(xs) for _ in range(rng.randrange(1, 4)))
    rows = [(f"{pick(['casino', 'win', 'bet'])}.com/{rng.randrange(99)}?q={k}", False) for k in range(80)] + [(f"{pick(['museum', 'art', 'city'])}.org/en/{rng.randrange(99)}#É{k}", True) for k in range(90)]
    want, grams, line = brute_deltas(rows)
    model = urls.fit(spark.createDataFrame(rows, "text string, accepted boolean"))
    got = {r.gram: r.delta for r in model.collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    scored = urls.score(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, text string, accepted boolean"), model, ["i", "accepted"])
    llr = {r.i: r.llr for r in scored.collect()}
    brute = {i: sum(want.get(g, 0.0) for g in grams(t)) / (len(line(t)) - 4) for i, (t, _) in enumerate(rows)}
    assert all(llr[i] == pytest.approx(brute[i]) for i in brute)
    for lost in (0.0, 0.1, 0.5):
        limit = urls.calibrate(scored, lost)
        good = [brute[i] for i, r in enumerate(rows) if r[1]]
        rejected = lambda x: sum(v < x - 1e-9 for v in good)
        assert rejected(limit) <= lost * len(good) < rejected(limit + 16 / 800 + 1e-6) + 1e-9 or limit >= 8
    assert urls.calibrate(scored.filter("not accepted")) == -float("inf")


def test_what_rules_test_is_no_part_of_the_models(spark):
    rows = [("a.example.net", "/en/x?q"), ("net", "/"), ("b.org", "/fr/"), ("c.example.com", "/de/1"), ("planet", "/deep"), ("x.io", "")]
    df = spark.createDataFrame(rows, "host string, tail string").select(*urls.told_by_rules(F.col("host"), F.col("tail")))
    assert [tuple(r) for r in df.collect()] == [("a.", "/x?q"), ("", "/"), ("b.", "/"), ("c.", "/1"), ("planet", "/deep"), ("x.io", "")]


def test_urls_of_clashing_columns_long_texts_and_empty_tables(spark):
    rows = [(1, "http://a.org/" + "x" * 20_000, "z"), (1, "http://a.org/" + "x" * 20_000, "z"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").withColumns({c: F.lit(c) for c in ("path", "rule", "llr", "gram", "uid", "site", "line")})
    got = urls.filter_urls(df).collect()
    assert [(r.page_id, r.rule, len(r.path)) for r in sorted(got, key=lambda r: r.page_id or 0)] == [(None, None, 0), (1, None, 20_001), (1, None, 20_001)]
    assert urls.filter_urls(df.filter("false"), seeds=False).count() == 0


def test_quality_bands_follow_the_labels(spark):
    rng = random.Random(7)
    good = lambda n: " ".join("".join(rng.choice("etaoinshrdlucmf") for _ in range(rng.randrange(2, 10))) for _ in range(n))
    poor = lambda n: " ".join("".join(rng.choice("etaoinshrdlucmf") for _ in range(rng.randrange(2, 10))) + "###" for _ in range(n))
    texts = [(i, good(300) if i % 4 else poor(205), int(bool(i % 4))) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(500, None), (3, "twice")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts if i < 160] + [(500, 1), (None, 1), (7, None), (8, 1)], "doc_id long, quality int")
    fixed = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    bands = quality.fit(docs, labels, least=40)
    kept = {r.doc_id: r.kept for r in quality.judge(docs, **bands).collect()}
    fresh = [(i, q) for i, _, q in texts if i >= 160]
    assert all(fixed[i] for i, _ in fresh) and all(kept[i] == bool(q) for i, q in fresh)
    assert quality.fit(docs, labels.filter("false")) == {"bands": quality.BANDS, "chunk_band": quality.CHUNK_BAND}
    assert quality.fit(docs.filter("false"), labels) == {"bands": quality.BANDS, "chunk_band": quality.CHUNK_BAND}
    # Lengths that no label shows keep the fixed limits.
    sizes = sorted(len(t) for i, t, q in texts if q and i < 160)
    assert quality.limits(sizes[-1] * 4, bands["bands"]) == quality.limits(sizes[-1] * 4) and quality.limits(200, bands["bands"]) == quality.limits(200)


def test_toxicity_learns_nothing_from_held_out_rows_ties_and_copies(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(80)] + [(3, "text 3"), (3, "other 3"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(4, 1), (5, 0), (3, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    held_out = {i for i in range(80) if zlib.crc32(str(i).encode()) % 4 == 2}
    got = sorted(toxicity.training_rows(docs, labels))
    sure = [i for i in range(80) if i not in held_out and i not in (4, 5)]
    want = [(f"text {i}", i % 2) for i in sure] + [("other 3", 1)] * (3 in sure) + [("", 1)] * (7 in sure)
    assert held_out and got == sorted(want)
    assert len(toxicity.training_rows(docs, labels, toxic=5, clean=7)) == 12


def test_toxicity_of_long_texts_and_parts(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(" ".join(words(rng, 12) + ["zzmoron"] * (i % 4 == 0) + words(rng, 3)), int(i % 4 == 0)) for i in range(240)]
    model = toxicity.fit(rows)
    texts = [t for t, _ in rows[:20]] + ["w1 " * 20_000 + "zzmoron", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: (round(r.score, 9), len(r.spans)) for r in toxicity.score_documents(docs, model).collect()}
    monkeypatch.setattr(toxicity, "PART", 100)
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    codes = toxicity.Codes(model)
    parts = {i: (round(model.score(f), 9), len(model.spans(f))) for i, t in enumerate(texts) for f in model.marginals([t], codes)}
    assert whole == parts and whole[20][1] == 1


def test_short_benchmark_items_count_as_whole_lines(spark):
    items = [(1, "Zebra"), (2, "two words"), (3, "two words"), (4, "..."), (5, "one two three four five")]
    docs = spark.createDataFrame([(1, "a zebra ran"), (2, "x\n ZEBRA! \nzebra"), (3, "two  words\n\nzebra"), (4, "a two words b"), (5, "so one two three four five it is")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = sorted((r.doc_id, r.item_id, r.distance, r.start_word, r.end_word) for r in decontam.find_items(docs, bench).collect())
    assert got == [(2, 1, 0, 1, 2), (3, 1, 0, 2, 3), (3, 2, 0, 0, 2), (3, 3, 0, 0, 2), (5, 5, 0, 1, 6)]
    assert sorted(r.doc_id for r in decontam.keep_clean(docs, bench).collect()) == [1, 4]


def test_licences_in_documents(spark):
    plain = "the river ran past the house and on\nthrough the field"
    notices = {1: "Released under the MIT License.", 2: "SPDX-License-Identifier: Apache-2.0", 3: "This work is licensed under CC BY-NC 4.0.", 4: "Licensed under the European Union Public Licence 1.2."}
    families = {1: "MIT", 2: "Apache-2.0", 3: "CC-BY-NC", 4: "EUPL-1.2"}
    rows = [(i, f"{plain}\n{n}\n{plain}") for i, n in notices.items()] + [(5, licenses.TEXTS["ISC"][0]), (6, plain), (7, None), (1, plain)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, findings string, family int")
    got = [(r.doc_id, [(f.family, f.start, f.end, f.probability > 0.5 and f.similarity >= 0.6) for f in r.findings]) for r in licenses.scan(docs).collect()]
    start = len(plain) + 1
    want = [(i, [(families[i], start, start + len(n), True)]) for i, n in notices.items()] + [(5, [("ISC", 0, len(licenses.TEXTS["ISC"][0]), True)]), (6, []), (7, []), (1, [])]
    assert sorted(got) == sorted(want)


def test_lines_beside_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a common line here", "r", 5, b"k"), (2, "a common line here\nx", "s", 6, b"l")], "doc_id long, text string, row string, dropped int, bitmap binary").withColumns({"ql_doc": F.lit(1), "doc": F.lit(2), "own": F.lit(3), "a.b": F.lit(4)})
    got = {r.doc_id: r for r in lines.deduplicate_lines(docs).collect()}
    assert got[2].text == "x" and got[2].ql_n_dropped == 1 and (got[2].row, got[2].dropped, got[2]["a.b"]) == ("s", 6, 4) and got[1].text == "a common line here"
    with pytest.raises(ValueError):
        lines.deduplicate_lines(docs.withColumn("ql_n_lines", F.lit(1)))


def test_repeats_shared_by_very_many_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert got == {i: 40 if i else 0 for i in range(300)}


def test_lines_of_a_text_with_very_many_runs(spark):
    n = 3000
    shared, own = [f"shared line number {i}" for i in range(n)], [f"own line of the second {i}" for i in range(n)]
    docs = spark.createDataFrame([(1, "\n".join(shared)), (2, "\n".join(x for pair in zip(shared, own) for x in pair))], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.deduplicate_lines(docs).collect()}
    assert got[1].text == "\n".join(shared) and got[1].ql_keep_bitmap is None
    assert got[2].text == "\n".join(own) and (got[2].ql_n_lines, got[2].ql_n_dropped) == (2 * n, n)
