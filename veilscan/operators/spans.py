"""Places in texts as tables of spans: what lies outside, what lies inside another, what a row of alike characters folds to, what a narrow picture shows.

All of it is a sort of a text's spans or characters and one walk along them by
windows, so time grows with their number and not with the pairs they make. Rows of
a text meet in one task, as the text does; nothing leaves the JVM. Null and empty
texts have no rows; rows that repeat a key are texts of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import ANSI, BIDI, CONFUSABLES, CONTROL, DEPRECATED, HOMOGLYPH_SCRIPTS, LINEBREAK, MARKER, NONCHAR, PUA, SPACE, TAGS, VS, ZERO_WIDTH, property_class
from ..functions import native
from . import cells


def outside(rows: DataFrame, is_span: str, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """The rows that are no spans and overlap none of the spans of the same ``by``: an interval anti join by one sorted sweep. The boolean column ``is_span`` tells which are spans; ends are exclusive."""
    span = F.col(is_span)
    along = Window.partitionBy(by).orderBy(F.col(start), F.desc(is_span)).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(by).orderBy(F.desc(start), F.col(is_span)).rowsBetween(Window.unboundedPreceding, -1)
    # how far the spans that begin no later reach, and where the next one begins
    swept = rows.withColumns({"_reach": F.max(F.when(span, F.col(end))).over(along), "_next": F.last(F.when(span, F.col(start)), ignorenulls=True).over(back)})
    clear = F.coalesce(F.col("_reach") <= F.col(start), F.lit(True)) & F.coalesce(F.col("_next") >= F.col(end), F.lit(True))
    return swept.filter(~span & clear).drop("_reach", "_next")


def outermost(spans: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """The spans that begin behind the end of every span before them; of equal starts the longest, of equal spans one."""
    order = Window.partitionBy(by).orderBy(F.col(start), F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_covered", F.max(end).over(order)).filter(F.coalesce(F.col(start) >= F.col("_covered"), F.lit(True))).drop("_covered")


def _runs(df: DataFrame, text: str, inside: str, key: str) -> DataFrame:
    """key, _row, start, offset, run: every longest run of characters of a class, with its place in characters and UTF-16 units."""
    order = Window.partitionBy("_row").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = cells._cut(df, text, f"[^{inside}]*+(?:[{inside}]++|\\z)", key).withColumn("run", F.regexp_replace("_piece", f"^[^{inside}]++", ""))
    to = F.sum(F.length("_piece")).over(order), F.sum(cells._units(F.col("_piece"))).over(order)
    return rows.select(key, "_row", (to[0] - F.length("run")).cast("int").alias("start"), (to[1] - cells._units(F.col("run"))).cast("int").alias("offset"), "run").filter("run <> ''")


_drawn = "".join(f"\\x{{{cp:X}}}" for cp, (to, _) in CONFUSABLES.items() if to.isalnum() or to in ".-")
_ascii = r"A-Za-z0-9.\-"


def with_host(df: DataFrame, run: str) -> DataFrame:
    """``df`` with ``host``, the host that a run of letters, digits and ``._@-`` begins with; '' for none. Labels are told apart as an array, since a pattern
    with a repeated group would nest as deep as there are labels; each step is a column, so that none is computed again for every label."""
    df = df.withColumn("_labels", F.split(F.regexp_extract(run, r"^[\p{L}\p{N}.-]*+", 0), r"\.", -1))
    sound = F.array_position(F.transform("_labels", lambda x: x.rlike(r"^[\p{L}\p{N}]")), False) - 1  # labels before the first that cannot be one; -1 if all can
    sound = F.least(F.when(sound < 0, F.size("_labels")).otherwise(sound), F.size("_labels") - 1)
    # the last label that may end a name; the first has none before it
    ends = F.filter(F.transform(F.slice("_labels", F.lit(2), F.greatest(sound, F.lit(0))), lambda x, i: F.when(x.rlike(r"^\p{L}{2}"), i + 1)), lambda i: i.isNotNull())
    df = df.withColumn("_at", F.array_max(ends))
    name = F.concat(F.array_join(F.slice("_labels", F.lit(1), F.greatest(F.coalesce("_at", F.lit(1)), F.lit(1))), "."), F.lit("."), F.regexp_extract(F.get("_labels", F.coalesce("_at", F.lit(0))), r"^\p{L}++", 0))
    return df.withColumn("host", F.when(F.col("_at").isNull(), F.lit("")).otherwise(name)).drop("_labels", "_at")


def _is_lookalike(host: Column) -> Column:
    """Whether all letters of a host beyond ASCII are drawn like ASCII, and it resolves as another. A label that begins with a digit beyond ASCII, or U+04C0, is no valid name."""
    return host.rlike(f"^[{_ascii}{_drawn}]+$") & host.rlike(r"[^\x00-\x7f]") & ~host.rlike(r"\x{4C0}|(?:^|\.)(?![0-9])\p{N}")


def mixed_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, offset, word: words of Latin letters and of letters of a script that passes for Latin, outside of lookalike hosts; micro with a unit is none."""
    script = lambda *names: property_class(*(f"Script={n}" for n in names))
    foreign, latin, inside = script(*HOMOGLYPH_SCRIPTS), script("Latin"), r"\p{L}\p{N}_"
    # a host is the beginning of a run of these, and words lie within one run; so a run's words and its host are swept together
    runs = _runs(df.filter(native.holds(F.col(text), f"[{foreign}]")), text, r"\p{L}\p{N}._@-", key).filter(F.col("run").rlike(f"[{foreign}]"))
    runs = with_host(runs, "run").withColumnRenamed("host", "_host").withColumn("_id", F.struct("_row", "start"))
    words = F.transform(F.filter(F.regexp_extract_all("run", F.lit(f"[^{inside}]*+(?:[{inside}]++|\\z)"), F.lit(0)), lambda x: x != ""), lambda x: F.struct(F.lit(False).alias("is_span"), x.alias("piece")))
    host = F.when(_is_lookalike(F.col("_host")), F.array(F.struct(F.lit(True).alias("is_span"), F.col("_host").alias("piece")))).otherwise(F.array().cast("array<struct<is_span: boolean, piece: string>>"))
    rows = runs.select(key, "_id", F.col("offset").alias("_offset"), F.posexplode(F.concat(host, words)).alias("_n", "_x")).select("*", "_x.*")
    order = Window.partitionBy("_id", "is_span").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    word = F.when(F.col("is_span"), F.col("piece")).otherwise(F.regexp_replace("piece", f"^[^{inside}]++", ""))
    rows = rows.withColumn("word", word).withColumns({"end": F.sum(F.length("piece")).over(order), "offset": (F.col("_offset") + F.sum(cells._units(F.col("piece"))).over(order) - cells._units(F.col("word"))).cast("int")})
    rows = rows.withColumn("start", F.col("end") - F.length("word")).filter("word <> ''")
    micro = r"^[_*]*[0-9.,]*\x{3BC}(?:s|sec|m|g|l|L|V|A|F|W|Hz|mol|Pa)[_*]*\z"
    mixed = F.col("word").rlike(f"[{foreign}]") & F.col("word").rlike(f"[{latin}]") & ~F.col("word").rlike(micro)
    return outside(rows.filter(F.col("is_span") | mixed), "is_span", "_id").select(key, "offset", "word")


#: How loud characters of a kind are; those that neighbours excuse, and those drawn like ASCII.
LOUDNESS = {TAGS: 5.0, VS: 5.0, ZERO_WIDTH: 4.5, BIDI: 4.5, CONTROL: 4.0, ANSI: 4.0, NONCHAR: 4.0, MARKER: 3.5, DEPRECATED: 3.5, PUA: 3.5, SPACE: 1.4, LINEBREAK: 1.4}
EXCUSED, DRAWN_ALIKE = 1.6, 2.5


def spectrum(df: DataFrame, columns: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bucket, i, cp, priority: a text as ``columns`` buckets of equal width, each with the loudest character of note in it, the first of equal ones. A bucket without one has no row: it is plain."""
    rows = cells.placed(df.withColumn("_size", F.length(text)), key, "_size", text=text).filter("kind is not null or to is not null")
    loud = F.create_map(*(F.lit(x) for pair in LOUDNESS.items() for x in pair))
    rows = rows.withColumn("priority", F.when(F.col("kind").isNull(), DRAWN_ALIKE).when(F.col("benign"), EXCUSED).otherwise(loud[F.col("kind")]))
    bucket = F.least(F.lit(columns - 1), F.floor(F.col("i") / (F.col("_size") / F.lit(float(columns))))).cast("int")
    best = F.max_by(F.struct("i", "cp", "priority"), F.struct("priority", -F.col("i"))).alias("b")
    return rows.groupBy("_row", key, bucket.alias("bucket")).agg(best).select(key, "bucket", "b.*")


#: Characters of a kind in a row from which they are folded, and how many are still shown.
FOLDED_FROM, SHOWN = 64, 48


def folded(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, i, kind, benign, n, shown, folded: rows of characters of note of one kind, run by run; of long ones, but for line breaks, only the first are shown."""
    rows = cells.placed(df, key, text=text).filter("kind is not null")
    island = F.col("i") - F.row_number().over(Window.partitionBy("_row", "kind", "benign").orderBy("i"))
    runs = rows.withColumn("_island", island).groupBy("_row", key, "kind", "benign", "_island").agg(F.min("i").alias("i"), F.count("*").cast("int").alias("n"))
    shown = F.when((F.col("n") >= FOLDED_FROM) & (F.col("kind") != LINEBREAK), F.lit(SHOWN)).otherwise(F.col("n"))
    return runs.select(key, "i", "kind", "benign", "n", shown.alias("shown"), (F.col("n") - shown).alias("folded"))
