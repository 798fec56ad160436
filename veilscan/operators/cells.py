"""Texts taken apart into the few characters of note and the stretches between them, and what follows from their order.

A regular expression cuts each text behind every character that may be of note;
the rows (stretch before it, character) are numbered, and the last may hold the rest.
A broadcast join says what each character is, and windows over a text's rows say
where it stands and what stands next to it. Only texts with such a character are
cut, only keys and pieces are shuffled, and nothing leaves the JVM. All rows of a
text meet in one task, as the text itself does.

Places are in characters (``i``) and in UTF-16 units (``offset``). Defined cases:
null and empty texts have no rows (views: empty texts); rows that repeat a key are
texts of their own; columns of other names than those returned do not matter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import codec, native
from ..functions.dims import BIDI, HIDDEN_KINDS, HIGH, MEDIUM, PUA, VS, ZERO_WIDTH, class_of, joiner_class, pictograph_class, point_rows, quiet_class, spans_by_kind

_kinds = pa.schema([("cp", pa.int32()), ("kind", pa.string()), ("abbr", pa.string()), ("severity", pa.int32()), ("to", pa.string()), ("script", pa.string()), ("via", pa.string())])


def points(spark: SparkSession) -> DataFrame:
    """The table of characters: cp, kind, abbr, severity; to, script, via. Some three thousand rows."""
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(_kinds.names, row, strict=True)) for row in point_rows()], _kinds))


def _frames(by: str = "_n") -> tuple[WindowSpec, WindowSpec, WindowSpec, WindowSpec]:
    """A text's rows in order: no frame, up to this one, before it, and behind it, the nearest last.

    The last is read backwards, as a frame up to the end of a text is filled anew for each row.
    """
    rows, back = Window.partitionBy("_row").orderBy(by), Window.partitionBy("_row").orderBy(F.desc(by))
    return rows, rows.rowsBetween(Window.unboundedPreceding, 0), rows.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)


def _units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def _cut(df: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """keep, _row, _n, _piece: what ``pattern`` matches, one after another. It has to match the rest of a text as well, or finding its end takes the square of its length."""
    base = df.select(*keep, F.monotonically_increasing_id().alias("_row"), F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda piece: piece != "").alias("_pieces"))
    return base.select(*keep, "_row", F.posexplode("_pieces").alias("_n", "_piece"))


def placed(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """A row for each character that may be of note, in texts that are not plain: keep, _row, _n, gap (the stretch before it), ch, cp, kind,
    abbr, severity, to, script, via, i, offset, hidden, benign. The last row of a text may have its rest as ``gap`` and no character."""
    order, upto, before, after = _frames()
    # plain characters are looked for first, in a class within the class
    quiet = f"[{native.PLAIN}[{quiet_class()}]]"
    rows = _cut(df.filter(native.noted(F.col(text)) != ""), text, f"{quiet}*+(?:(?s:.)|\\z)", *keep)
    last = F.right("_piece", F.lit(1))
    ch = F.when(last.rlike(f"^{quiet}"), F.lit("")).otherwise(last)
    rows = rows.select(*keep, "_row", "_n", "_piece", ch.alias("ch")).select(*keep, "_row", "_n", "ch", F.substr("_piece", F.lit(1), F.length("_piece") - F.length("ch")).alias("gap"), F.when(F.col("ch") != "", F.ascii("ch")).alias("cp"))
    rows = rows.join(F.broadcast(points(df.sparkSession)), "cp", "left")
    private = [F.col("cp").between(low, high) for low, high in spans_by_kind()[PUA]]
    is_private = private[0] | private[1] | private[2]
    known = {"kind": F.lit(PUA), "abbr": F.when(F.col("cp") < 0xF0000, "PUA").when(F.col("cp") < 0x100000, "PUA-A").otherwise("PUA-B"), "severity": F.lit(MEDIUM)}
    rows = rows.withColumns({name: F.coalesce(name, F.when(is_private, value)) for name, value in known.items()})
    hidden = F.coalesce(F.col("kind").isin(*HIDDEN_KINDS), F.lit(False))
    rows = rows.withColumn("hidden", hidden).withColumns({"_start": F.nullif(F.left("gap", F.lit(1)), F.lit("")), "_end": F.nullif(F.right("gap", F.lit(1)), F.lit(""))})
    seen = F.when(~F.col("hidden") & (F.col("ch") != ""), F.col("ch"))
    rows = rows.withColumns(
        {
            "i": (F.sum(F.length("gap") + F.length("ch")).over(upto) - F.length("ch")).cast("int"),
            "offset": (F.sum(_units(F.col("gap")) + _units(F.col("ch"))).over(upto) - _units(F.col("ch"))).cast("int"),
            # the character before, and the nearest ones that are drawn
            "_prior": F.coalesce("_end", F.lag("ch").over(order)),
            "_left": F.coalesce("_end", F.last(F.coalesce(seen, "_end"), ignorenulls=True).over(before)),
            "_right": F.last(F.coalesce("_start", seen), ignorenulls=True).over(after),
        }
    )
    return rows.withColumn("benign", F.coalesce(_excused(), F.lit(False))).drop("_start", "_end", "_prior", "_left", "_right")


def _excused() -> Column:
    """Whether neighbours excuse a hidden character: a mark at the start, a selector behind what it selects for, a joiner between pictographs or in a script that uses joiners."""
    pictograph, joiner = (lambda c, inside=inside: F.coalesce(F.col(c).rlike(f"^[{inside}]"), F.lit(False)) for inside in (pictograph_class(), joiner_class()))
    prior, cp = F.col("_prior"), F.col("cp")
    flag = F.ascii(prior).between(0x1F1E6, 0x1F1FF) & (cp == 0xFE0F)
    emoji = (cp == 0x200D) & pictograph("_left") & pictograph("_right")
    return F.when(cp == 0xFEFF, F.col("i") == 0).when(cp.isin(0xFE0E, 0xFE0F), pictograph("_prior") | prior.rlike("^[#*0-9]") | flag).when(cp.isin(0x200C, 0x200D), emoji | joiner("_left") | joiner("_right"))


CELL = ("i", "offset", "cp", "ch", "kind", "abbr", "severity", "hidden", "benign", "to", "script", "via")


def cells(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each character of note or with an ASCII twin: its place in characters and UTF-16 units, what it is, and whether its neighbours excuse it."""
    return placed(df, key, text=text).filter("kind is not null or to is not null").select(key, *CELL)


def _joined(pieces: str) -> Column:
    return F.array_join(F.transform(F.array_sort(pieces), lambda x: x["piece"]), "")


def marks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each run of hidden characters that nothing excuses: ``at``, the number of other characters before it, context (the last 28 of these), cps, abbrs."""
    order, upto, _, _ = _frames()
    rows = placed(df, key, text=text).withColumn("_gone", F.col("hidden") & ~F.col("benign"))
    begins = F.col("_gone") & ~(F.coalesce(F.lag("_gone").over(order), F.lit(False)) & (F.col("gap") == ""))
    rows = rows.withColumn("_begins", begins).withColumn("_run", F.sum(F.col("_begins").cast("int")).over(upto))
    # each run with the stretch right before it, and what is drawn between it and the next one
    kept = F.when(~F.col("_gone"), F.struct("_n", F.right(F.concat("gap", "ch"), F.lit(28)).alias("piece")))
    gone = F.when(F.col("_gone"), F.struct("_n", "cp", "abbr"))
    head = F.max(F.when(F.col("_begins"), F.col("gap")))
    runs = rows.groupBy("_row", "_run", key).agg(
        F.right(_joined(F.collect_list(kept)), F.lit(28)).alias("_tail"), F.coalesce(F.sum(F.when(~F.col("_gone"), F.length("gap") + F.length("ch"))), F.lit(0)).alias("_size"),
        F.coalesce(head, F.lit("")).alias("_head"), F.array_sort(F.collect_list(gone)).alias("_marks"),
    )
    of_text, so_far, _, _ = _frames("_run")
    before = F.right(F.concat(F.coalesce(F.lag("_tail").over(of_text), F.lit("")), "_head"), F.lit(28))
    runs = runs.withColumns({"_seen": before, "at": (F.sum(F.length("_head") + F.col("_size")).over(so_far) - F.col("_size")).cast("int")})
    # between two runs something is drawn, so 28 of them hold the last 28 characters
    context = F.right(F.array_join(F.collect_list("_seen").over(of_text.rowsBetween(-27, 0)), ""), F.lit(28))
    return runs.withColumn("context", context).filter("_run > 0").select(key, "at", "context", F.transform("_marks", lambda m: m["cp"]).alias("cps"), F.transform("_marks", lambda m: m["abbr"]).alias("abbrs"))


def views(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, visible_text (nothing hidden) and human_text (what is excused or directs stays). Texts in which neighbours can excuse nothing are not taken apart."""
    marked = F.coalesce(native.holds(F.col(text), f"[{class_of(VS, ZERO_WIDTH)}]"), F.lit(False))
    plain = df.filter(~marked).select(key, F.coalesce(native.visible_text(F.col(text)), F.lit("")).alias("visible_text"), F.coalesce(native.human_text(F.col(text)), F.lit("")).alias("human_text"))
    rows = placed(df.filter(marked), key, text=text)
    unseen = {"visible_text": F.col("hidden"), "human_text": F.col("hidden") & ~F.col("benign") & (F.col("kind") != BIDI)}
    pieces = [_joined(F.collect_list(F.struct("_n", F.concat("gap", F.when(gone, F.lit("")).otherwise(F.col("ch"))).alias("piece")))).alias(name) for name, gone in unseen.items()]
    return plain.unionByName(rows.groupBy("_row", key).agg(*pieces).drop("_row"))


def stacks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, depth, offset: the deepest stack of combining marks of a text (the first of these) and its last mark. Characters of note in a stack neither count nor part it."""
    noted, base = class_of(*spans_by_kind()), r"\p{Mn}\p{Me}"
    rows = _cut(df.filter(native.holds(F.col(text), f"[{base}]")), text, f"[^{base}{noted}]*+(?:[{base}{noted}]++|\\z)", key)
    stack = F.regexp_replace("_piece", f"^[^{base}{noted}]++", "")
    # noted characters at the end do not belong to it
    own = F.reverse(F.regexp_replace(F.reverse("_piece"), f"^[{noted}]++", ""))
    at = F.sum(_units(F.col("_piece"))).over(_frames()[1]) - _units(F.col("_piece"))
    rows = rows.withColumns({"_depth": F.length(F.regexp_replace(stack, f"[{noted}]++", "")), "_offset": at + _units(own) - _units(F.right(own, F.lit(1)))})
    return rows.filter("_depth > 0").groupBy("_row", key).agg(F.max("_depth").alias("depth"), F.max_by("_offset", F.struct("_depth", -F.col("_n"))).cast("int").alias("offset")).drop("_row")


def stack_findings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, severity, depth, offset of stacks that are deeper than any script writes."""
    return stacks(df, key, text).filter("depth >= 5").select(key, F.when(F.col("depth") >= 12, HIGH).otherwise(MEDIUM).alias("severity"), "depth", "offset")


# Payloads


def zero_width_readings(df: DataFrame, cps: str) -> DataFrame:
    """``df`` with ``text`` and ``scheme``, the best reading as bits of the zero-width characters in the array ``cps``: of two kinds, one bit each, either way
    round; of three or four, two bits each; the high bit first or the low one. Null if none reads as text. Of equal ones the first is taken."""
    # letters for the characters, in their order; functions of one character must not look at the row, or it is computed anew for each
    letter = F.create_map(*(F.lit(x) for pair in zip(sorted(codec.ZERO_WIDTH_ALPHABET), "abcdefg", strict=True) for x in pair))
    df = df.withColumn("_signs", F.array_join(F.transform(F.filter(cps, lambda cp: cp.isin(*codec.ZERO_WIDTH_ALPHABET)), lambda cp: letter[cp]), ""))
    df = df.withColumn("_alphabet", F.array_join(F.array_sort(F.array_distinct(F.split("_signs", ""))), ""))
    df = df.withColumn("_places", F.when(F.length("_signs") >= 8, F.call_function("translate", "_signs", "_alphabet", F.lit("0123"))))
    two, four = F.length("_alphabet") == 2, F.length("_alphabet").isin(3, 4)
    wide = F.col("_places")
    for digit, bits in (("0", "aa"), ("1", "ab"), ("2", "ba"), ("3", "bb")):
        wide = F.replace(wide, F.lit(digit), F.lit(bits))
    ways = (("binary, {}-first", two, F.col("_places")), ("binary, {}-first, inverted", two, F.translate("_places", "01", "10")), ("base-4, {}-first", four, F.translate(wide, "ab", "01")))
    names = []
    for scheme, fits, bits in ways:
        for first in ("MSB", "LSB"):
            names.append((f"_said{len(names)}", scheme.format(first)))
            df = df.withColumn(names[-1][0], F.when(fits, native.lossy(native.octets_of(bits, first == "MSB"))))
    scored = [F.struct(native.text_score(F.col(c)).alias("score"), F.lit(-n).alias("order"), F.col(c).alias("text"), F.lit(scheme).alias("scheme")) for n, (c, scheme) in enumerate(names)]
    good = F.filter(F.array(*scored), lambda x: (F.length(x["text"]) >= 3) & (x["score"] >= 0.85))
    best = F.array_max(good)
    return df.withColumns({"text": best["text"], "scheme": best["scheme"]}).drop("_signs", "_alphabet", "_places", *(c for c, _ in names))


def payloads(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, id, decoded, scheme: what zero-width characters and variation selectors of a text say that nothing excuses, where it reads as text."""
    rows = placed(df.filter(native.holds(F.col(text), f"[{class_of(VS, ZERO_WIDTH)}]")), key, text=text).filter(F.col("kind").isin(VS, ZERO_WIDTH) & ~F.col("benign"))
    of_kind = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("_n", "cp")))), lambda x: x["cp"])
    read = rows.groupBy("_row", key).agg(of_kind(VS).alias("_vs"), of_kind(ZERO_WIDTH).alias("_zw"))
    bytes_said = read.select(key, native.decode_variation_selectors(F.col("_vs")).alias("decoded")).filter((native.text_score(F.col("decoded")) >= 0.85) & (native.utf16_units(F.col("decoded")) >= 2))
    bits_said = zero_width_readings(read.select(key, "_zw"), "_zw").filter("text is not null")
    none = F.lit(None).cast("string")
    return bytes_said.select(key, F.lit("variation-selectors").alias("id"), "decoded", none.alias("scheme")).unionByName(bits_said.select(key, F.lit("zero-width").alias("id"), F.col("text").alias("decoded"), "scheme"))
