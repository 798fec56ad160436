"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose ratio reaches a cutoff, and a stratum has one
cutoff for all rules, so that one bound holds for what they reject together. It
is chosen on labelled documents. The cutoffs of a fixed grid are tested from the
largest down, as a smaller one rejects all that a larger one does: the hypothesis
"the rules reject more than ``alpha`` of the good documents of the stratum" falls
if the exact binomial tail P(Bin(n, alpha) <= k), k of n good holdout documents
being rejected, is at most ``delta`` over the number of strata (Bonferroni). The
first hypothesis that stands ends the sequence, for which reason its tests need
no correction among themselves. All cutoffs before that are safe, whichever is
taken: with probability 1 - ``delta`` at least, no stratum rejects more than
``alpha`` of its good documents by them. A stratum without a safe cutoff rejects
by the base rules alone; that is so with fewer than ln(delta / strata) /
ln(1 - alpha) good labels, 217 for four strata.

Defined cases: a null text has no words; a null stratum is a stratum of its own;
a document labelled more than once counts as good if any label says so; null
labels and labels of unknown documents count for nothing; with no labels only
the base rules reject. Repeated rows are judged alike. Columns of the input
other than the named ones are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, meet, stored

RULES = ("symbols", "bangs", "dup_lines", "repeats")
GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0)
WINDOW = 8
#: Terms of the binomial tail that are summed one by one; a geometric bound, never too small, stands for the rest.
TERMS = 4000
#: Strata whose cutoffs are broadcast at most; more meet their documents by ``meet``.
BROADCAST_ROWS = 20_000
#: The share of a stratum's good documents that the rules may reject together, and the chance that they reject more in some stratum.
ALPHA, DELTA = 0.02, 0.05


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text`` and with n_words, word_chars, n_symbols, n_bangs, n_lines, n_dup_lines, n_repeat_words.

    Repeated windows are found by 64-bit hashes of eight words.
    """
    names = ("_t", "_w", "_h1", "_h2", "_h4", "_h8", "_s", "_p")
    t, w, h1, h2, h4, h8, s, p = map(F.col, names)
    n = F.col("n_words").cast("int")
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).drop(text)
    df = df.withColumn("_w", F.split(F.trim(t, F.lit(" \t\n\x0b\x0c\r")), WORD_SPACE))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_h1": F.when((F.size(w) == 1) & (w[0] == ""), F.array().cast("array<bigint>")).otherwise(F.transform(w, lambda x: F.xxhash64(x))), "_l": lines})
    df = df.select(
        *[c for c in df.columns if c not in ("_t", "_w", "_l", "_h1")],
        "_h1",
        F.size(h1).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct(F.col("_l")))).cast("long").alias("n_dup_lines"),
    )
    none = F.array().cast("array<bigint>")

    def doubled(x: Column, by: int) -> Column:
        """Hashes of twice as many words, from those that start ``by`` words apart."""
        return F.when(n >= WINDOW, F.zip_with(F.slice(x, 1, F.size(x) - by), F.slice(x, by + 1, F.size(x) - by), lambda a, b: F.xxhash64(a, b))).otherwise(none)

    for made, of, by in (("_h2", h1, 1), ("_h4", h2, 2), ("_h8", h4, 4)):
        df = df.withColumn(made, doubled(of, by)).drop(of)
    df = df.withColumn("_s", F.when(F.size(F.array_distinct(h8)) < F.size(h8), F.sort_array(F.transform(h8, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h8")
    again = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"])
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))).drop("_s")
    gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(WINDOW), b - a))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_p")


def _log_gamma(x: Column) -> Column:
    """Of x >= 1, by Stirling's series ten further on."""
    y = x + 10.0
    far = (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y)
    for i in range(10):
        far = far - F.log(x + float(i))
    return far


def binomial_tail(k: Column, n: Column, alpha: float) -> Column:
    """log P(Bin(n, alpha) <= k) for k < n alpha; 0 elsewhere, which no test passes."""
    k, n = k.cast("double"), n.cast("double")
    first = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(alpha) + (n - k) * math.log1p(-alpha)
    odds = (1 - alpha) / alpha
    summed = F.aggregate(
        F.sequence(F.lit(0), F.least(k.cast("int"), F.lit(TERMS))),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct((a["t"] * (k - i) / (n - k + i + 1) * odds).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: a["s"] + a["t"] / (1 - k * odds / (n - k + 1)),
    )
    return F.when(k < n * alpha, F.least(F.lit(0.0), first + F.log(summed))).otherwise(0.0)


def _ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "bangs": F.col("n_bangs") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
    }


def cutoffs(held: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """From labelled rows (stratum, good boolean, the counts of ``features``): (stratum, cutoff) for each stratum that has a safe one.

    Of the safe cutoffs, the one with most rejected bad documents less ten times
    the rejected good ones, if that is more than nothing; of equal ones the largest.
    """
    grid = F.array(*map(F.lit, GRID))
    top = F.greatest(*_ratios().values())
    counts = held.select("stratum", "good", F.size(F.filter(grid, lambda c: c <= top)).alias("g")).groupBy("stratum", "g").agg(F.count_if("good").alias("fp"), F.count_if(~F.col("good")).alias("tp"))
    by_stratum = counts.groupBy("stratum").agg(F.collect_list(F.struct("g", "fp", "tp")).alias("c"), F.sum("fp").alias("n"))
    reached = lambda k: F.aggregate(F.filter("c", lambda x: x["g"] >= F.col("j")), F.lit(0).cast("long"), lambda a, x: a + x[k])
    tests = by_stratum.select("stratum", "n", F.explode(F.sequence(F.lit(1), F.lit(len(GRID)))).alias("j"), "c").select("stratum", "n", F.get(grid, F.col("j") - 1).alias("cutoff"), *[reached(k).alias(k) for k in ("fp", "tp")])
    strata = by_stratum.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_strata"))
    falls = binomial_tail(F.col("fp"), F.col("n"), alpha) <= F.log(F.lit(delta) / F.col("n_strata"))
    gain = F.col("tp") - 10 * F.col("fp")
    tested = tests.crossJoin(F.broadcast(strata)).groupBy("stratum").agg(F.max(F.when(~falls, F.col("cutoff"))).alias("stands"), F.collect_list(F.struct(gain.alias("gain"), F.col("cutoff"))).alias("t"))
    safe = F.filter("t", lambda x: (x["gain"] > 0) & (x["cutoff"] > F.coalesce(F.col("stands"), F.lit(0.0))))
    return tested.select("stratum", F.array_max(safe)["cutoff"].alias("cutoff")).filter("cutoff is not null")


_JUDGED = "_row"


def _judged(rows: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """Rows of (_row, stratum, text) with the counts, base_failed, failed_rules and kept; _row is a struct with doc_id."""
    counted = stored(features(rows))
    good = labels.select(F.col("doc_id").alias("_id"), F.col("quality")).filter("quality is not null").groupBy("_id").agg((F.max("quality") >= 1).alias("good"))
    held = counted.withColumn("_id", F.col("_row.doc_id")).drop(_JUDGED).join(good, "_id")
    cuts = stored(cutoffs(held, alpha, delta))
    joined = counted.join(F.broadcast(cuts), "stratum", "left") if cuts.count() <= BROADCAST_ROWS else meet(counted, cuts, "stratum", "left")
    failed = F.array_compact(F.array(*[F.when(v >= F.col("cutoff"), F.lit(r)) for r, v in _ratios().items()]))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return joined.withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("cutoff")


def _stratum(of: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(of)), F.lit("null")).alias("stratum")


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Every row of ``docs`` judged: doc_id, stratum, the counts, base_failed, failed_rules array, kept."""
    rows = docs.select(F.struct(F.col(doc_id).alias("doc_id")).alias(_JUDGED), _stratum(stratum), F.col(text).alias("text"))
    out = _judged(rows, labels, alpha, delta)
    return out.select("_row.doc_id", *[c for c in out.columns if c != _JUDGED])


def kept_documents(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` (with a doc_id) that are kept, with all their columns."""
    rows = docs.select(F.struct("*").alias(_JUDGED), _stratum(stratum), F.col(text).alias("text"))
    return _judged(rows, labels, alpha, delta).filter("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """``documents`` judged against ``labels``, a stratum per language."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_ratio_sql = {"symbols": "n_symbols / greatest(n_words, 1)", "bangs": "n_bangs / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)"}
#: The query, with the binomial tail summed term by term.
SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w
), again AS (
  SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + {WINDOW - 1}], ' ')) > 1
), covered AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(later - i, {WINDOW})))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS later FROM again) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    length(text) - length(replace(text, '!', '')) AS n_bangs, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), ratio AS (
  SELECT doc_id, stratum, greatest({", ".join(_ratio_sql.values())}) AS v FROM c
), labelled AS (
  SELECT doc_id, max(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), held AS (
  SELECT * FROM ratio JOIN labelled USING (doc_id)
), tests AS (
  SELECT stratum, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND v >= cutoff) AS fp, count(*) FILTER (WHERE NOT good AND v >= cutoff) AS tp
  FROM held, (SELECT unnest({list(GRID)}::DOUBLE[]) AS cutoff) GROUP BY ALL
), tested AS (
  SELECT *, fp < n * {ALPHA} AND list_sum(list_transform(range(0, fp + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))))
    <= {DELTA} / (SELECT count(DISTINCT stratum) FROM held) AS falls FROM tests
), safe AS (
  SELECT * FROM (SELECT *, bool_and(falls) OVER (PARTITION BY stratum ORDER BY cutoff DESC) AS reached FROM tested) WHERE reached AND tp > 10 * fp
), best AS (
  SELECT * FROM safe QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY tp - 10 * fp DESC, cutoff DESC) = 1
), failed AS (
  SELECT DISTINCT doc_id FROM ratio JOIN best USING (stratum) WHERE v >= cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND doc_id NOT IN (FROM failed) AS kept
FROM c
"""
