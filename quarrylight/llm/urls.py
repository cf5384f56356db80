"""URL filtering by a character language-model ratio (operator 1, native).

Two smoothed variable-order Markov models, one of accepted and one of rejected
URLs, are kept as one table of strings ("grams") of up to ``order`` characters:
a gram's probability given what precedes its last character is interpolated
with that of the next shorter one. A URL's score is the sum, over all its
grams, of what each adds to the log ratio of its suffix; the sum telescopes to
the longest known context at every character. Divided by the length, it is held
against a limit that is calibrated on labelled URLs the models have not seen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import ascii_lower, settle, table

ORDER = 5
#: Grams seen less often are no part of the models; all others are.
MIN_COUNT = 4
#: Rows that look up their distinct grams together.
GROUP = 4096
SUBSET_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Prior weight of the shorter context, and the size of the alphabet.
TAU, ALPHABET = 4.0, 64.0
FOLDS = 5
#: The share of accepted URLs that the limit may reject.
LOST = 0.005

#: (host and path prefix, accepted)
RULES = (("net/", False), ("example.net/en/", True), ("example.com/de/", False), ("org/fr/", True))

#: Words that unwanted and wanted sites commonly carry in their URLs; with the
#: rules' own decisions they are what the models learn from.
REJECTED_WORDS = "ad ads adserver adult banner bet bets betting bonus casino cheap click counterfeit coupon crack dating deal farm free gamble gambling hack jackpot keygen loan lottery payday pharma pill pills poker popup porn promo replica sex slots spam track tracker torrent viagra warez win winner xxx".split()
ACCEPTED_WORDS = "about academy archive article blog book books city community data docs edu encyclopedia garden guide health history home journal language library magazine market media museum music news paper press program project reference research review school science story study support travel university weather wiki world".split()


def after_scheme(url: Column) -> Column:
    """What follows ``://``; empty where the url is null or has none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    return F.coalesce(rest, F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path up to ``?`` or ``#``; both empty
    where the url is null or has no ``://``."""
    rest = after_scheme(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.char_length(host) + 1, F.char_length(rest))
    return ascii_lower(host), F.regexp_extract(tail, r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's string and its verdict (null: none fits)."""
    name, accepted = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        name, accepted = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(verdict)).otherwise(accepted)
    return name, accepted


def told_by_rules(host: Column, tail: Column, rules=RULES) -> tuple[Column, Column]:
    """host and tail without the domains and the path starts that any rule tests:
    these say what the rules decide, not what other sites are like."""
    alternatives = lambda xs: "|".join(re.escape(x) for x in sorted(xs, key=lambda x: (-len(x), x)))
    domains, paths = {r[0].partition("/")[0] for r in rules}, {p for r in rules if (p := r[0].partition("/")[2])}
    if domains:
        host = F.regexp_replace(host, rf"(^|\.)(?:{alternatives(domains)})$", "$1")
    return host, F.regexp_replace(tail, f"^/(?:{alternatives(paths)})", "/") if paths else tail


def grams_of(line: Column, order: int) -> Column:
    """All substrings of 1 to ``order`` characters of a padded line."""
    spots = F.sequence(F.lit(order), F.char_length(line))
    return F.flatten(F.transform(spots, lambda i: F.transform(F.sequence(F.lit(1), F.lit(order)), lambda k: F.substring(line, i - k + 1, k))))


def padded(text: Column, order: int) -> Column:
    """The text as the models read it: order - 1 start marks, then a-z, digits
    and separators; other characters are one class, digits another."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[^a-z0/\.\-_~%?#&=+:]", "x")
    return F.concat(F.lit("^" * (order - 1)), plain, F.lit("$"))


def fit(labelled: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, tau: float = TAU) -> DataFrame:
    """gram, delta from rows (text, accepted).

    All grams with min_count occurrences or more, so the model grows with the
    input. Without rows of both labels the deltas are 0 or pull one way.
    """
    lines = labelled.filter(F.col("text").isNotNull() & F.col("accepted").isNotNull()).select(padded(F.col("text"), order).alias("line"), "accepted")
    counted = (
        lines.select(F.explode(grams_of(F.col("line"), order)).alias("gram"), "accepted")
        .groupBy("gram")
        .agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"))
        .filter(F.col("yes") + F.col("no") >= min_count)
    )
    counts = settle(counted, "url-grams")
    # Context totals, then each gram with the counts of all of its suffixes.
    context = counts.groupBy(F.expr("left(gram, char_length(gram) - 1)").alias("ctx")).agg(F.sum("yes").alias("ctx_yes"), F.sum("no").alias("ctx_no"))
    suffix = counts.select("gram", F.explode(F.sequence(F.lit(1), F.char_length("gram"))).alias("k")).select("gram", "k", F.expr("right(gram, k)").alias("part"))
    known = counts.select(F.col("gram").alias("part"), "yes", "no").join(context, F.expr("left(part, char_length(part) - 1)") == F.col("ctx"))
    steps = suffix.join(known, "part").groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", "yes", "ctx_yes", "no", "ctx_no"))).alias("steps"))

    def prob(steps, hit, total):
        return F.aggregate(steps, F.lit(1.0 / ALPHABET), lambda p, s: (s[hit] + F.lit(tau) * p) / (s[total] + F.lit(tau)))

    def ratio(steps):
        return F.log(prob(steps, "yes", "ctx_yes")) - F.log(prob(steps, "no", "ctx_no"))

    own = F.col("steps")
    shorter = F.slice(own, 1, F.greatest(F.lit(0), F.size(own) - 1))
    return steps.select("gram", (ratio(own) - ratio(shorter)).alias("delta"))


def score(rows: DataFrame, model: DataFrame, keys: list[str], text_col: str = "text", order: int = ORDER) -> DataFrame:
    """keys and ``llr``, the log-likelihood difference per character.

    Rows are dealt into groups; each group's distinct grams are joined with the
    model, and only what the model knows of them comes back to the group. So
    neither the model is broadcast nor the grams of every row are shuffled.
    """
    spark = rows.sparkSession
    lines = settle(rows.select(*keys, padded(F.coalesce(F.col(text_col), F.lit("")), order).alias("line")), "url-lines")
    groups = lines.count() // GROUP + 1
    dealt = lines.withColumn("ql_group", F.pmod(F.xxhash64(F.lit(23), *keys), F.lit(groups)))
    grams = F.explode(grams_of(F.col("line"), order)).alias("gram")
    known = dealt.select("ql_group", grams).distinct().join(model, "gram").select("ql_group", "gram", "delta")
    each = dealt.repartition("ql_group").select("ql_group", *keys, (F.char_length("line") - (order - 1)).alias("n"), grams)
    found = each.join(known.repartition("ql_group").hint("shuffle_hash"), ["ql_group", "gram"], "left")
    scored = found.groupBy("ql_group", *keys).agg((F.coalesce(F.sum("delta"), F.lit(0.0)) / F.max("n")).alias("llr")).drop("ql_group")
    # Both sides are dealt by group already; the grams need no other shuffle.
    before = spark.conf.get(SUBSET_KEYS, None)
    try:
        spark.conf.set(SUBSET_KEYS, "false")
        return settle(scored, "url-scores")
    finally:
        spark.conf.set(SUBSET_KEYS, before) if before is not None else spark.conf.unset(SUBSET_KEYS)


def calibrate(scored: DataFrame, lost: float = LOST, bins: int = 800, span: float = 8.0) -> float:
    """The greatest limit that rejects at most the share ``lost`` of accepted
    URLs, from scores (llr, accepted) of labelled URLs. A histogram of fixed
    size comes to the driver. Without accepted URLs nothing is rejected."""
    bin_of = F.least(F.greatest(F.floor((F.col("llr") + span) / (2 * span) * bins), F.lit(0)), F.lit(bins - 1))
    rows = scored.filter("accepted").groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).collect()
    counts = {r.bin: r.n for r in rows}
    allowed, below, i = lost * sum(counts.values()), 0, 0
    if not counts:
        return -float("inf")
    while below + counts.get(i, 0) <= allowed:
        below, i = below + counts.get(i, 0), i + 1
    return i / bins * 2 * span - span


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER, seeds: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict, llr, limit for every row of pages.

    The rules decide first; elsewhere a URL is allowed if its score reaches the
    limit. The model of rejected URLs learns from those that the rules block and,
    with ``seeds``, from a list of words; that of accepted ones from those that
    the rules allow, from the other word list and from URLs that no rule decides
    and that have no word of the first list: what is not known to be unwanted
    counts as ordinary. What the rules themselves test, domain and path, is left
    out of all of them. Every fifth site, by hash, is kept for the calibration.

    The models read host, path, query and fragment. Cases: a null or schemeless
    url has an empty host and path and is judged by its end mark alone. Repeated
    rows are judged one by one. An empty table gives no rows; other columns are
    not read.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.regexp_extract(after_scheme(F.col(url_col)), r"^[^/?#]*(?s:(.*))", 1).alias("tail"))
    name, accepted = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", "tail", name.alias("rule"), accepted.alias("accepted"), F.concat("host", "tail").alias("text"))
    odd = F.lit(seeds) & F.lower("text").rlike(r"(?<![a-z])(" + "|".join(REJECTED_WORDS) + r")(?![a-z])")
    ordinary = F.coalesce(F.col("accepted"), F.when(~odd, True))
    other, tail = told_by_rules(F.col("host"), F.col("tail"), rules)
    labelled = rows.select(F.col("host").alias("site"), F.concat(other, tail).alias("text"), ordinary.alias("accepted"), F.lit(True).alias("real")).filter("accepted IS NOT NULL AND text <> ''").distinct()
    if seeds:
        words = [(f"{a}{w}{b}{end}", f"{a}{w}{b}{end}{path}", ok) for ws, ok in ((REJECTED_WORDS, False), (ACCEPTED_WORDS, True)) for w in ws for a in ("", "www.", "m.", "blog.", "my-", "the-") for b in ("", "-site") for end in (".", ".com", ".net", ".org") for path in ("/", "/en/1")]
        labelled = labelled.unionByName(pages.sparkSession.createDataFrame(words, "site string, text string, accepted boolean").withColumn("real", F.lit(False)))
    # Whole sites are held back, else the models would know them by name.
    fold = F.pmod(F.xxhash64(F.lit(5), F.col("site")), F.lit(FOLDS))
    train = labelled.filter(fold != 0)
    model = settle(fit(train, order), "url-model")
    held = score(labelled.filter(fold == 0), model, ["site", "text", "accepted", "real"], "text", order)
    # The word lists say nothing of how URLs are spread.
    limit = calibrate(held.filter("real"))
    texts = rows.withColumns({"uid": F.monotonically_increasing_id(), "text": F.concat(*told_by_rules(F.col("host"), F.col("tail"), rules))})
    judged = score(texts, model, ["uid", "page_id", "host", "path", "rule", "accepted"], "text", order)
    allow = F.coalesce(F.col("accepted"), F.col("llr") >= limit)
    return judged.select("page_id", "host", "path", "rule", F.when(allow, "allow").otherwise("block").alias("verdict"), "llr", F.lit(limit).alias("limit"))


def op1_url_filter(spark, sf_dir):
    """Verdicts on every url of ``pages``."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
