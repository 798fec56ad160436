"""Queries over the test corpus and the pages, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import native
from ..functions.dims import BIDI, CONFUSABLES, HIDDEN_KINDS, HOMOGLYPH_SCRIPTS, INTENTS, LINEBREAK, SPACE, STRIPPABLE_KINDS, ZERO_WIDTH, class_of, intent_pattern, spans_by_kind
from ..functions.markup import CARRIERS
from ..functions.urls import LABEL_TLDS, SAME_OWNER, SHARED_SUFFIXES
from ..operators import cells, spans
from ..operators import scan as ops
from ..sources import files, reports, sinks
from . import expected, injection
from .injection import injected

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if "WITH inj AS" in sql or sql.lstrip().startswith(("WITH", "SELECT page_id, -1", "SELECT conv_id")) else f"{injection.SQL} {sql}"
        return f

    return add


def _n(*kinds: str) -> str:
    """SQL: characters of some kinds."""
    return f"(length(text) - length(regexp_replace(text, '[{class_of(*kinds)}]', '', 'g')))"


def _class(points) -> str:
    return "".join(f"\\x{{{cp:X}}}" for cp in sorted(points))


_KINDS = sorted(spans_by_kind())
_kind_case = "CASE " + " ".join(f"WHEN regexp_matches(ch, '^[{class_of(k)}]$') THEN '{k}'" for k in spans_by_kind()) + " END"
_chars = ", cells AS (SELECT doc_id, lang, i, ch, unicode(ch) AS cp, i - 1 + coalesce(sum(CASE WHEN unicode(ch) > 65535 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM (SELECT doc_id, lang, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM inj WHERE {}) WHERE ch <> '')"
_suspect_sql = f"regexp_matches(text, '[{class_of(*spans_by_kind())}]')"


@query(f"""
SELECT doc_id, length(text)::BIGINT AS codepoints, (length(text) + length(text) - length(regexp_replace(text, '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::BIGINT AS units, strlen(text)::BIGINT AS bytes,
  {_n(*HIDDEN_KINDS)}::BIGINT AS hidden, (length(text) - length(regexp_replace(text, '[{_class(CONFUSABLES)}]', '', 'g')))::BIGINT AS lookalikes FROM inj""")
def doc_codepoint_stats(spark, sf_dir):
    t = F.col("text")
    return injected(spark, sf_dir).select("doc_id", native.codepoints(t).alias("codepoints"), native.utf16_units(t).alias("units"), native.utf8_bytes(t).alias("bytes"), native.count_kind(t, *HIDDEN_KINDS).alias("hidden"), native.confusable_count(t).alias("lookalikes"))


@query(_chars.format(_suspect_sql) + f" SELECT {_kind_case} AS kind, count(*) AS n_chars, count(DISTINCT doc_id) AS n_docs, min(cp)::INT AS least, max(cp)::INT AS greatest FROM cells WHERE {_kind_case} IS NOT NULL GROUP BY 1")
def kind_histogram(spark, sf_dir):
    """Characters are counted before they are told apart, so the long list of kinds is looked through once for each distinct one."""
    # the quick pass leaves little of most texts, and the long class is looked for in what is left
    noted = injected(spark, sf_dir).select("doc_id", native.noted(F.col("text")).alias("t")).filter("t <> ''")
    chars = noted.select(F.explode(native.chars(F.col("t"))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    kinds = chars.withColumn("kind", native.kind_of(F.col("ch"))).filter("kind is not null").groupBy("kind").agg(F.sum("n").alias("n_chars"), F.min(F.ascii("ch")).alias("least"), F.max(F.ascii("ch")).alias("greatest"))
    held = F.array_compact(F.array(*[F.when(F.col("t").rlike(f"[{class_of(k)}]"), F.lit(k)) for k in _KINDS]))
    docs = noted.select("doc_id", F.explode(held).alias("kind")).groupBy("kind").agg(F.countDistinct("doc_id").alias("n_docs"))
    return kinds.join(docs, "kind").select("kind", "n_chars", "n_docs", "least", "greatest")


@query(_chars.format(f"regexp_matches(text, '[{class_of(ZERO_WIDTH)}]')") + f" SELECT doc_id, (i - 1)::INT AS i, unit::BIGINT AS unit, cp::INT AS cp FROM cells WHERE regexp_matches(ch, '^[{class_of(ZERO_WIDTH)}]$')")
def zero_width_positions(spark, sf_dir):
    """Places in characters and UTF-16 units, within the row: the stretches between hits are added up, and only hits are exploded."""
    one = f"[{class_of(ZERO_WIDTH)}]"
    some = injected(spark, sf_dir).filter(F.col("text").rlike(one))
    hits, before = F.regexp_extract_all("text", F.lit(one), F.lit(0)), F.split("text", one)
    steps = F.zip_with(hits, F.slice(before, F.lit(1), F.size(hits)), lambda h, b: F.struct(F.length(b).alias("n"), native.utf16_units(b).alias("units"), F.ascii(h).alias("cp")))
    zero = F.struct(F.lit(-1).alias("i"), F.lit(-1).cast("long").alias("unit"), F.array().cast("array<struct<i: int, unit: bigint, cp: int>>").alias("out"))

    def step(a, x):
        i, unit = a["i"] + 1 + x["n"], a["unit"] + 1 + x["units"]
        return F.struct(i.alias("i"), (unit + F.when(x["cp"] > 65_535, 1).otherwise(0)).alias("unit"), F.concat(a["out"], F.array(F.struct(i.alias("i"), unit.alias("unit"), x["cp"].alias("cp")))).alias("out"))

    return some.select("doc_id", F.explode(F.aggregate(steps, zero, step)["out"]).alias("x")).select("doc_id", "x.*")


_said_sql = ", ".join(f"CASE WHEN regexp_matches(decoded, '{intent_pattern(p, 're2').replace(chr(39), chr(39) * 2)}') THEN '{label}' END" for label, p in INTENTS)


@query(_chars.format("regexp_matches(text, '[\\x{E0020}-\\x{E007E}]')") + f", said AS (SELECT doc_id, string_agg(chr((cp - 917504)::INT), '' ORDER BY i) AS decoded, count(*) AS n FROM cells WHERE cp BETWEEN 917536 AND 917630 GROUP BY doc_id) SELECT doc_id, decoded, n, array_to_string(list_filter([{_said_sql}], lambda x: x IS NOT NULL), ', ') AS intents FROM said")
def tags_decoded(spark, sf_dir):
    said = injected(spark, sf_dir).filter(F.col("text").rlike(r"[\x{E0020}-\x{E007E}]")).select("doc_id", native.decode_tags(F.col("text")).alias("decoded"))
    return said.select("doc_id", "decoded", F.length("decoded").cast("long").alias("n"), F.array_join(native.intents(F.col("decoded")), ", ").alias("intents"))


_opens, _closes = "[\\x{202A}\\x{202B}\\x{202D}\\x{202E}\\x{2066}-\\x{2068}]", "[\\x{202C}\\x{2069}]"
_rtl_sql = "[" + "".join(f"\\p{{{s}}}" for s in ("Arabic", "Hebrew", "Syriac", "Thaana", "Nko", "Samaritan", "Mandaic", "Adlam")) + "]"


@query(
    _chars.format(f"regexp_matches(text, '[{class_of(BIDI)}]')")
    + f""", steps AS (SELECT doc_id, sum(CASE WHEN regexp_matches(ch, '{_opens}') THEN 1 WHEN regexp_matches(ch, '{_closes}') THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth, i FROM cells),
  depths AS (SELECT doc_id, min(depth) AS low, arg_max(depth, i) AS last FROM steps GROUP BY doc_id)
  SELECT doc_id, {_n(BIDI)}::BIGINT AS n, (CASE WHEN regexp_matches(text, '[\\x{{202D}}\\x{{202E}}]') THEN 4 WHEN NOT regexp_matches(text, '{_rtl_sql}') THEN 3 WHEN low < 0 OR last <> 0 THEN 3 WHEN NOT regexp_matches(text, '[\\x{{202A}}-\\x{{202E}}\\x{{2066}}-\\x{{2069}}]') THEN 1 ELSE 2 END)::INT AS severity
  FROM inj JOIN depths USING (doc_id)"""
)
def bidi_severity(spark, sf_dir):
    """The depth of controls is folded within the row."""
    t = F.col("text")
    rows = injected(spark, sf_dir).filter(t.rlike(f"[{class_of(BIDI)}]"))
    step = lambda c: F.when(c.rlike(_opens), 1).when(c.rlike(_closes), -1).otherwise(0)
    controls = F.regexp_extract_all("text", F.lit(f"[{class_of(BIDI)}]"), F.lit(0))
    rows = rows.withColumn("d", F.aggregate(controls, F.struct(F.lit(0).alias("last"), F.lit(0).alias("low")), lambda a, c: F.struct((a["last"] + step(c)).alias("last"), F.least(a["low"], a["last"] + step(c)).alias("low"))))
    rtl = "[" + "".join(rf"\p{{script={s}}}" for s in ("Arabic", "Hebrew", "Syriac", "Thaana", "Nko", "Samaritan", "Mandaic", "Adlam")) + "]"
    severity = F.when(t.rlike(r"[\x{202D}\x{202E}]"), 4).when(~t.rlike(rtl), 3).when((F.col("d.low") < 0) | (F.col("d.last") != 0), 3).when(~t.rlike(r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"), 1).otherwise(2)
    return rows.select("doc_id", native.count_kind(t, BIDI).alias("n"), severity.alias("severity"))


@query("SELECT doc_id, " + ", ".join(f"{_n(k)}::BIGINT AS n_{k.replace('-', '_')}" for k in _KINDS) + f" FROM inj WHERE {_suspect_sql}")
def class_counts(spark, sf_dir):
    rows = injected(spark, sf_dir).filter(native.holds(F.col("text"), f"[{class_of(*spans_by_kind())}]"))
    return rows.select("doc_id", *[native.count_kind(F.col("text"), k).alias(f"n_{k.replace('-', '_')}") for k in _KINDS])


_punctuation = [cp for cp, (to, _) in CONFUSABLES.items() if not to.isalnum()]


@query(f"SELECT doc_id, (length(text) - length(regexp_replace(text, '[{_class(_punctuation)}]', '', 'g')))::BIGINT AS n FROM inj WHERE regexp_matches(text, '[{_class(_punctuation)}]')")
def typographic_punctuation(spark, sf_dir):
    found = F.regexp_count("text", F.lit(f"[{_class(_punctuation)}]")).cast("long").alias("n")
    return injected(spark, sf_dir).filter(F.col("text").rlike(f"[{_class(_punctuation)}]")).select("doc_id", found)


_foreign_sql = ", ".join(f"CASE WHEN regexp_matches(word, '\\p{{{s}}}') THEN '{s}' END" for s in HOMOGLYPH_SCRIPTS)


@query(f", words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM inj), named AS (SELECT doc_id, word, array_to_string(list_filter([{_foreign_sql}], lambda x: x IS NOT NULL), '+') AS scripts FROM words WHERE regexp_matches(word, '\\p{{Latin}}')) SELECT doc_id, word, scripts FROM named WHERE scripts <> ''")
def mixed_script_words(spark, sf_dir):
    rows = injected(spark, sf_dir).filter(F.col("text").rlike("[" + "".join(rf"\p{{script={s}}}" for s in HOMOGLYPH_SCRIPTS) + "]"))
    words = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]{2,}"), 0)).alias("word")).filter(F.col("word").rlike(r"\p{script=Latin}"))
    scripts = F.array_join(F.array_compact(F.array(*[F.when(F.col("word").rlike(rf"\p{{script={s}}}"), F.lit(s)) for s in HOMOGLYPH_SCRIPTS])), "+")
    return words.withColumn("scripts", scripts).filter("scripts <> ''")


_share_scripts = ("Latin", *HOMOGLYPH_SCRIPTS)
_letters_sql = "(length(text) - length(regexp_replace(text, '\\p{L}', '', 'g')))"


@query(", shares AS (" + " UNION ALL ".join(f"SELECT doc_id, '{s}' AS script, (length(text) - length(regexp_replace(text, '[\\p{{{s}}}]', '', 'g')))::DOUBLE / {_letters_sql} AS share FROM inj WHERE {_letters_sql} > 0" for s in _share_scripts) + ") SELECT doc_id, script, round(share, 6) AS share FROM shares WHERE share > 0")
def native_script_share(spark, sf_dir):
    """Letters of ASCII are counted by taking them out run by run, the others in what is left without ASCII."""
    rows = injected(spark, sf_dir).select("doc_id", native.n_plain_letters(F.col("text")).alias("n"), native.beyond_ascii(F.col("text")).alias("rest"))
    rows = rows.select("doc_id", "n", "rest", (F.col("n") + F.regexp_count("rest", F.lit(r"\p{L}"))).alias("letters"))
    in_script = lambda s: F.regexp_count("rest", F.lit(rf"\p{{script={s}}}")) + (F.col("n") if s == "Latin" else F.lit(0))
    shares = F.array(*[F.struct(F.lit(s).alias("script"), (in_script(s) / F.col("letters")).alias("share")) for s in _share_scripts])
    return rows.select("doc_id", F.explode(shares).alias("x")).filter("x.share > 0").select("doc_id", "x.script", F.round("x.share", 6).alias("share"))


_twins = {cp: to for cp, (to, _) in CONFUSABLES.items() if to.isalnum()}
_from, _to = "".join(map(chr, _twins)), "".join(_twins.values())
_twin_scripts = [x for x in HOMOGLYPH_SCRIPTS if any(CONFUSABLES[cp][1] == x for cp in _twins)]
_twins_in = {x: _class(cp for cp in _twins if CONFUSABLES[cp][1] == x) for x in _twin_scripts}
_owner_share_sql = "CASE " + " ".join(f"WHEN regexp_matches(word, '^[{_twins_in[x]}]') THEN length(text) - length(regexp_replace(text, '\\p{{{x}}}', '', 'g'))" for x in _twin_scripts) + " ELSE 0 END"


@query(f", words AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]{{4,}}')) AS word FROM inj WHERE regexp_matches(text, '[{_class(_twins)}]{{4,}}')) SELECT doc_id, word, translate(word, {injection.sql_text(_from)}, '{_to}') AS reads_as FROM words WHERE regexp_matches(word, '^[{_class(_twins)}]+$') AND NOT regexp_matches(word, '\\p{{Latin}}') AND 5 * ({_owner_share_sql}) < {_letters_sql}")
def spoofed_words(spark, sf_dir):
    """Words that are drawn like Latin ones, where their script is not one of the text's own: in a fifth of its letters."""
    t = F.col("text")
    rows = injected(spark, sf_dir).filter(native.holds(t, f"[{_class(_twins)}]{{4,}}"))
    letters = native.n_plain_letters(t) + F.regexp_count(native.beyond_ascii(t), F.lit(r"\p{L}"))
    own = F.array_compact(F.array(*[F.when(5 * F.regexp_count(native.beyond_ascii(t), F.lit(rf"\p{{script={x}}}")) >= letters, F.lit(x)) for x in _twin_scripts]))
    words = rows.select("doc_id", own.alias("own"), F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]{4,}"), 0)).alias("word"))
    script = None
    for x in _twin_scripts:
        is_of = F.col("word").rlike(f"^[{_twins_in[x]}]")
        script = F.when(is_of, F.lit(x)) if script is None else script.when(is_of, F.lit(x))
    found = words.filter(F.col("word").rlike(f"^[{_class(_twins)}]+$") & ~F.col("word").rlike(r"\p{script=Latin}") & ~F.coalesce(F.array_contains("own", script), F.lit(False)))
    return found.select("doc_id", "word", F.translate("word", _from, _to).alias("reads_as"))


_dim_sql = ", dim(cp, target, script) AS (VALUES " + ", ".join(f"({cp}, '{to.replace(chr(39), chr(39) * 2)}', '{s}')" for cp, (to, s) in CONFUSABLES.items()) + ")"


@query(_chars.format(f"regexp_matches(text, '[{_class(CONFUSABLES)}]')") + _dim_sql + " SELECT script, target, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM cells JOIN dim USING (cp) GROUP BY ALL")
def confusable_histogram(spark, sf_dir):
    """The join of characters with the dimension of lookalikes, a broadcast of a fixed table."""
    dim = spark.createDataFrame([(cp, to, s) for cp, (to, s) in CONFUSABLES.items()], "cp int, target string, script string")
    chars = injected(spark, sf_dir).filter(native.holds(F.col("text"), f"[{_class(CONFUSABLES)}]")).select("doc_id", F.explode(native.chars(native.noted(F.col("text")))).alias("ch")).withColumn("cp", F.ascii("ch"))
    return chars.join(F.broadcast(dim), "cp").groupBy("script", "target").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("""
, ends AS (SELECT doc_id, (length(text) - length(replace(text, chr(13) || chr(10), chr(10))))::BIGINT AS crlf, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS lf, (length(text) - length(replace(text, chr(13), '')))::BIGINT AS cr FROM inj)
SELECT doc_id, crlf, lf - crlf AS lf, cr - crlf AS cr FROM ends WHERE (crlf > 0)::INT + (lf > crlf)::INT + (cr > crlf)::INT >= 2""")
def line_ending_mix(spark, sf_dir):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    rows = injected(spark, sf_dir).select("doc_id", count("\r\n").alias("crlf"), count("(?<!\r)\n").alias("lf"), count("\r(?!\n)").alias("cr"))
    return rows.filter("cast(crlf > 0 as int) + cast(lf > 0 as int) + cast(cr > 0 as int) >= 2")


_hits_sql = " UNION ALL ".join(f"SELECT doc_id, lang, '{label}' AS label FROM inj WHERE regexp_matches(text, '{intent_pattern(p, 're2').replace(chr(39), chr(39) * 2)}')" for label, p in INTENTS)


@query(f", hits AS ({_hits_sql}) SELECT doc_id, label FROM hits")
def intent_hits(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", ops.intents().alias("labels")).select("doc_id", F.explode("labels").alias("label"))


@query(f", hits AS ({_hits_sql}) SELECT lang, label, count(*) AS n FROM hits GROUP BY ALL")
def intent_by_lang(spark, sf_dir):
    return injected(spark, sf_dir).select("lang", ops.intents().alias("labels")).select("lang", F.explode("labels").alias("label")).groupBy("lang", "label").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->') AS found FROM pages) SELECT page_id, len(found)::BIGINT AS n_comments, coalesce(list_sum(list_transform(found, lambda x: length(x))), 0)::BIGINT AS n_chars FROM c")
def html_comment_count(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r"(?s)<!--.*?-->"), 0)
    return injection.table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_comments"), F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))


_shared_sql = "(" + ", ".join(f"'{s}'" for s in sorted(SHARED_SUFFIXES)) + ")"
_owner_sql = "CASE site " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in sorted(SAME_OWNER.items())) + " ELSE site END"
_last = lambda n: f"array_to_string(parts[-{n}:], '.')"


@query(
    f"WITH hosts AS (SELECT page_id, lower(regexp_extract(url, '^\\s*(?:https?:)?//(?:[^/@\\s]*@)?([^/?#\\s:]+)', 1)) AS host FROM pages), split AS (SELECT page_id, host, string_split(host, '.') AS parts FROM hosts), "
    f"sites AS (SELECT page_id, host, CASE WHEN {_last(3)} IN {_shared_sql} THEN {_last(4)} WHEN {_last(2)} IN {_shared_sql} THEN {_last(3)} ELSE {_last(2)} END AS site FROM split) SELECT page_id, host, {_owner_sql} AS site FROM sites"
)
def page_hosts(spark, sf_dir):
    pages = injection.table(spark, sf_dir, "pages").select("page_id", native.host_of(F.col("url")).alias("host"))
    return pages.withColumn("site", native.registrable(F.col("host")))


# Patterns that Java and RE2 read alike. Links and images of Markdown and HTML, their targets, and what is named in labels.
_value = r"""(?:"[^"]*"|'[^']*'|[^\s>"']+)"""
_rest = r"""(?:"[^"]*"|'[^']*'|[^>"'])*?"""
_inline_target = r"\(\s*<?([^)\s>]+)>?\s*(?:\"[^\"]*\")?\s*\)"
_md_links = r"(?:^|[^!])\[([^\]\n!][^\]\n]{0,199})\]" + _inline_target
_html_links = rf"(?is)<a\b{_rest}\shref\s*=\s*({_value}){_rest}>(.{{0,400}}?)</\s*a\s*>"
_md_images = r"!\[[^\]\n]{0,200}\]" + _inline_target
_html_images = rf"(?is)<img\b{_rest}\ssrc\s*=\s*({_value}){_rest}>"
_labels = r"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+"
_explicit_host = rf"(?i)(?:https?://|\bwww\.)({_labels}[a-z]{{2,24}})"
_bare_host = rf"(?i)(?:^|[\s(<\"'])({_labels}(?:{'|'.join(LABEL_TLDS)}))(?:[^a-z0-9-]|$)"
_target_host = r"(?i)^\s*(?:https?:)?//(?:[^/@\s]*@)?([^/?#\s:]+)"
_quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
_bare_value_sql = lambda x: f"regexp_replace({x}, '^[\"'']|[\"'']$', '', 'g')"
_plain_sql = lambda x: f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_site_sql = lambda host: f"(SELECT {_owner_sql} FROM (SELECT CASE WHEN {_last(3)} IN {_shared_sql} THEN {_last(4)} WHEN {_last(2)} IN {_shared_sql} THEN {_last(3)} ELSE {_last(2)} END AS site FROM (SELECT string_split(lower({host}), '.') AS parts)))"


def _bare_value(x):
    return F.regexp_replace(x, "^[\"']|[\"']$", "")


def _zipped(of: str, pattern: str, first: int, second: int):
    """Two groups of every match."""
    return F.arrays_zip(F.regexp_extract_all(of, F.lit(pattern), F.lit(first)).alias("x"), F.regexp_extract_all(of, F.lit(pattern), F.lit(second)).alias("y"))


@query(f""", links AS (
  SELECT doc_id, unnest(list_zip(regexp_extract_all(text, {_quoted(_md_links)}, 1), regexp_extract_all(text, {_quoted(_md_links)}, 2))) AS l FROM inj UNION ALL
  SELECT doc_id, unnest(list_zip(regexp_extract_all(text, {_quoted(_html_links)}, 2), list_transform(regexp_extract_all(text, {_quoted(_html_links)}, 1), lambda x: {_bare_value_sql("x")}))) FROM inj
), named AS (
  SELECT doc_id, coalesce(nullif(regexp_extract({_plain_sql("l[1]")}, {_quoted(_explicit_host)}, 1), ''), regexp_extract({_plain_sql("l[1]")}, {_quoted(_bare_host)}, 1)) AS label, lower(regexp_extract(l[2], {_quoted(_target_host)}, 1)) AS target FROM links
)
SELECT doc_id, label, target FROM named WHERE label <> '' AND target <> '' AND {_site_sql("label")} <> {_site_sql("target")}""")
def link_mismatch(spark, sf_dir):
    """Links of Markdown and HTML whose label names another owner's host than their target."""
    rows = injected(spark, sf_dir).filter(F.contains("text", F.lit("](")) | F.col("text").rlike("(?i)<a\\b"))
    links = F.concat(_zipped("text", _md_links, 1, 2), F.transform(_zipped("text", _html_links, 2, 1), lambda l: F.struct(l["x"].alias("x"), _bare_value(l["y"]).alias("y"))))
    one = rows.select("doc_id", F.explode(links).alias("l")).select("doc_id", F.trim(F.regexp_replace(F.regexp_replace("l.x", "<[^>]*>", " "), r"\s+", " ")).alias("said"), F.col("l.y").alias("to"))
    label = F.coalesce(F.nullif(F.regexp_extract("said", _explicit_host, 1), F.lit("")), F.regexp_extract("said", _bare_host, 1))
    named = one.select("doc_id", label.alias("label"), F.lower(F.regexp_extract("to", _target_host, 1)).alias("target"))
    # as variables, so that the long expressions of both hosts are not written out for each use
    apart = F.exists(F.array(F.struct("label", "target")), lambda p: native.registrable(p["label"]) != native.registrable(p["target"]))
    return named.filter((F.col("label") != "") & (F.col("target") != "") & apart)


_carriers = "|".join(CARRIERS)
_carrying = rf"(?i)[?&](?:[^=&]*\W)?(?:{_carriers})(?:\W[^=&]*)?(?:[=&]|$)"
_open_slot = r"(?i)=(?:$|&)|[{<\[]\s*[a-z_ ]{2,30}\s*[}>\]]|\bYOUR_|\bINSERT|\bPUT_"


@query(f""", urls AS (
  SELECT doc_id, unnest(regexp_extract_all(text, {_quoted(_md_images)}, 1)) AS url FROM inj UNION ALL SELECT doc_id, {_bare_value_sql("unnest(regexp_extract_all(text, " + _quoted(_html_images) + ", 1))")} FROM inj
)
SELECT doc_id, lower(regexp_extract(url, {_quoted(_target_host)}, 1)) AS host, regexp_matches(substr(url, strpos(url, '?') + 1), {_quoted(_open_slot)}) AS open_slot FROM urls WHERE regexp_matches(url, {_quoted(_carrying)}) AND regexp_matches(url, {_quoted(_target_host)})""")
def exfil_images(spark, sf_dir):
    """Images of Markdown and HTML with a parameter that carries data, and whether it waits to be filled."""
    rows = injected(spark, sf_dir).filter(F.contains("text", F.lit("![")) | F.col("text").rlike("(?i)<img\\b"))
    urls = F.concat(F.regexp_extract_all("text", F.lit(_md_images), F.lit(1)), F.transform(F.regexp_extract_all("text", F.lit(_html_images), F.lit(1)), _bare_value))
    images = rows.select("doc_id", F.explode(urls).alias("url")).filter(F.col("url").rlike(_carrying) & F.col("url").rlike(_target_host))
    return images.select("doc_id", native.host_of(F.col("url")).alias("host"), F.substring_index("url", "?", -1).rlike(_open_slot).alias("open_slot"))


_targets = r"""(?i)(?:(?:href|src|action)\s*=\s*("[^"]*"|'[^']*')|\]\(\s*([a-z]+:[^)\s]*))"""
_code = r"(?i)^\s*(javascript|vbscript|data)\s*:"
_idle = r"(?i)^\s*(?:data\s*:\s*image/|javascript\s*:\s*(?:void\s*\(?\s*0\s*\)?)?\s*;?\s*$)"


@query(f""", found AS (
  SELECT doc_id, unnest(list_zip(regexp_extract_all(text, {_quoted(_targets)}, 1), regexp_extract_all(text, {_quoted(_targets)}, 2))) AS t FROM inj
), targets AS (SELECT doc_id, {_bare_value_sql("coalesce(nullif(t[1], ''), t[2])")} AS target FROM found)
SELECT doc_id, lower(regexp_extract(target, {_quoted(_code)}, 1)) AS scheme, count(*) AS n FROM targets WHERE regexp_matches(target, {_quoted(_code)}) AND NOT regexp_matches(target, {_quoted(_idle)}) GROUP BY ALL""")
def executable_hrefs(spark, sf_dir):
    """Targets in attributes and Markdown that are run and not fetched."""
    found = injected(spark, sf_dir).filter(F.col("text").rlike(r"(?i)(?:javascript|vbscript|data)\s*:")).select("doc_id", F.explode(_zipped("text", _targets, 1, 2)).alias("t"))
    targets = found.select("doc_id", _bare_value(F.coalesce(F.nullif(F.col("t.x"), F.lit("")), F.col("t.y"))).alias("target")).filter(F.col("target").rlike(_code) & ~F.col("target").rlike(_idle))
    return targets.groupBy("doc_id", F.lower(F.regexp_extract("target", _code, 1)).alias("scheme")).agg(F.count("*").alias("n"))


_run = "(?:[A-Za-z0-9+/]{4}){10,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"


@query(f", runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_run}')) AS run FROM inj) SELECT doc_id, length(run)::INT AS n, from_base64(run) IS NOT NULL AS unpacks FROM runs")
def base64_runs(spark, sf_dir):
    runs = injected(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_run), 0)).alias("run"))
    return runs.select("doc_id", F.length("run").alias("n"), F.try_to_binary("run", F.lit("base64")).isNotNull().alias("unpacks"))


@query(f"SELECT doc_id, regexp_replace(text, '[{class_of(*HIDDEN_KINDS)}]', '', 'g') AS visible FROM inj WHERE regexp_matches(text, '[{class_of(*HIDDEN_KINDS)}]')")
def visible_texts(spark, sf_dir):
    return injected(spark, sf_dir).filter(F.col("text").rlike(f"[{class_of(*HIDDEN_KINDS)}]")).select("doc_id", native.visible_text(F.col("text")).alias("visible"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[{class_of(*STRIPPABLE_KINDS)}]', '', 'g'), '[{class_of(SPACE)}]', ' ', 'g'), '[{class_of(LINEBREAK)}]', chr(10), 'g') AS stripped FROM inj")
def stripped_texts(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", native.stripped_text(F.col("text")).alias("stripped"))


@query(_chars.format(f"regexp_matches(text, '[{class_of(*HIDDEN_KINDS)}]')") + f", cps AS (SELECT doc_id, list(cp::BIGINT ORDER BY i) AS cps FROM cells WHERE regexp_matches(ch, '^[{class_of(*HIDDEN_KINDS)}]$') GROUP BY doc_id) SELECT doc_id, len(cps)::BIGINT AS hidden, printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, flatten(list_transform(cps, lambda x: [x & 255, (x >> 8) & 255, (x >> 16) & 255]))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)) AS signature FROM cps")
def mark_fingerprint(spark, sf_dir):
    rows = injected(spark, sf_dir).filter(native.holds(F.col("text"), f"[{class_of(*HIDDEN_KINDS)}]"))
    cps = F.transform(F.filter(native.chars(native.noted(F.col("text"))), lambda c: c.rlike(f"^[{class_of(*HIDDEN_KINDS)}]$")), lambda c: F.ascii(c))
    return rows.select("doc_id", cps.alias("cps")).select("doc_id", F.size("cps").cast("long").alias("hidden"), native.fingerprint(F.col("cps")).alias("signature"))


_shown = lambda of: f"regexp_replace({of}, '[{class_of(*HIDDEN_KINDS)}]', '', 'g')"


@query(f"SELECT d.doc_id, CASE WHEN inj.text = d.text THEN 'identical' WHEN {_shown('inj.text')} <> {_shown('d.text')} THEN 'edited' ELSE 'marked' END AS relation, {_n(*HIDDEN_KINDS).replace('text', 'inj.text')}::BIGINT AS hidden FROM inj JOIN documents d USING (doc_id)")
def copy_relations(spark, sf_dir):
    """Each document and its copy with payloads, as two copies of one text."""
    d = injection.table(spark, sf_dir, "documents")
    both = injection.inject(d.withColumn("original", F.col("text"))).select("doc_id", "original", "text")
    relation = F.when(F.col("text") == F.col("original"), "identical").when(native.visible_text(F.col("text")) != native.visible_text(F.col("original")), "edited").otherwise("marked")
    return both.select("doc_id", relation.alias("relation"), native.count_kind(F.col("text"), *HIDDEN_KINDS).alias("hidden"))


@query(f", first AS (SELECT doc_id, regexp_extract(text, '(?s)^([^{class_of(ZERO_WIDTH)}]*)[{class_of(ZERO_WIDTH)}]', 1) AS before FROM inj WHERE regexp_matches(text, '[{class_of(ZERO_WIDTH)}]')), ends AS (SELECT doc_id, before, string_split(before, chr(10)) AS lines FROM first) SELECT doc_id, len(lines)::INT AS line, (length(lines[-1]) + length(lines[-1]) - length(regexp_replace(lines[-1], '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) + 1)::INT AS col FROM ends")
def sarif_line_col(spark, sf_dir):
    before = F.regexp_extract("text", f"(?s)^([^{class_of(ZERO_WIDTH)}]*)[{class_of(ZERO_WIDTH)}]", 1)
    rows = injected(spark, sf_dir).filter(F.col("text").rlike(f"[{class_of(ZERO_WIDTH)}]")).withColumn("unit", native.utf16_units(before))
    line, column = sinks.line_and_column(F.col("text"), F.col("unit"))
    return rows.select("doc_id", line.alias("line"), column.alias("col"))


# control sequences, operating system commands up to their end or the text's, and single characters
_sequences = {"csi": "\\[[0-9;?<>=]*[ -/]*[@-~]", "osc": "\\](?s:.*?)(?:\\x07|\\x1b\\\\|$)", "single": "[@-Z\\\\^_]"}
_any_sequence = "\\x1b(?:" + "|".join(_sequences.values()) + ")"


@query(f", found AS (SELECT doc_id, regexp_extract_all(text, '{_any_sequence}') AS x FROM inj WHERE contains(text, chr(27))) SELECT doc_id, len(x)::BIGINT AS n, " + ", ".join(f"len(list_filter(x, lambda s: regexp_matches(s, '^\\x1b{start}')))::BIGINT AS n_{name}" for name, start in (("csi", "\\["), ("osc", "\\]"), ("single", "[^\\[\\]]"))) + " FROM found")
def ansi_sequences(spark, sf_dir):
    found = injected(spark, sf_dir).filter(F.contains("text", F.lit("\x1b"))).select("doc_id", F.regexp_extract_all("text", F.lit(_any_sequence.replace("$)", "\\z)")), F.lit(0)).alias("x"))
    of = lambda start: F.size(F.filter("x", lambda s: s.rlike(f"^\\x1b{start}"))).cast("long")
    return found.select("doc_id", F.size("x").cast("long").alias("n"), of("\\[").alias("n_csi"), of("\\]").alias("n_osc"), of("[^\\[\\]]").alias("n_single"))


@query("SELECT doc_id FROM inj WHERE nfc_normalize(text) <> text")
def not_nfc(spark, sf_dir):
    return ops.findings(injected(spark, sf_dir)).filter("id = 'not-nfc'").select("doc_id")


@query(f"SELECT doc_id, {_n(*HIDDEN_KINDS)}::BIGINT AS hidden FROM inj ORDER BY hidden DESC, doc_id LIMIT 10")
def top_k_hidden(spark, sf_dir):
    rows = injected(spark, sf_dir).select("doc_id", native.count_kind(F.col("text"), *HIDDEN_KINDS).alias("hidden"))
    return rows.orderBy(F.desc("hidden"), "doc_id").limit(10)


@query(f"SELECT lang, source, count(*) AS n_docs, count(*) FILTER (WHERE {_n(*HIDDEN_KINDS)} > 0) AS n_hidden, sum({_n(*HIDDEN_KINDS)})::BIGINT AS hidden FROM inj GROUP BY ROLLUP (lang, source)")
def hidden_rollup_lang_source(spark, sf_dir):
    rows = injected(spark, sf_dir).withColumn("h", native.count_kind(F.col("text"), *HIDDEN_KINDS))
    return rows.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("h") > 0).alias("n_hidden"), F.sum("h").alias("hidden"))


#: Names of files, and whether each is text that is read.
_files = (
    ("notes.md", True), ("RUN.PY", True), ("a.png", False), (".env", True), (".ENV.local", True), ("env", False), ("x.tar.gz", False), ("Makefile", True), ("makefile", False), ("LICENSE", True), ("licence", False), (".gitignore", True), ("d.Json", True), ("e.exe", False),
    ("rules.mdc", True), (".md", False), ("a.environment", False), ("Dockerfile", True), ("Dockerfile.dev", False), ("q.ipynb", True),
)
_file_rows = ", ".join(f"({i}, '{name}', {readable})" for i, (name, readable) in enumerate(_files))


@query(f"WITH kinds(k, name, readable) AS (VALUES {_file_rows}) SELECT doc_id, 'dir/' || name AS path, readable FROM documents JOIN kinds ON k = doc_id % {len(_files)}")
def file_type_predicate(spark, sf_dir):
    name = F.get(F.array(*[F.lit(f"dir/{name}") for name, _ in _files]), (F.col("doc_id") % len(_files)).cast("int"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", name.alias("path")).withColumn("readable", files.readable(F.col("path")))


# The whole reading, against what is expected of each class of payloads.


def _joined(column: str, by: str):
    return F.array_join(F.col(column).cast("array<string>"), by).alias(column)


def _with_path(rows):
    return rows.withColumn("path", F.concat(F.lit("docs/"), F.col("doc_id")))


@query(expected.FINDINGS_SQL)
def scan_findings(spark, sf_dir):
    labels = F.array_join(F.transform("intents", lambda x: x["label"]), "|").alias("intents")
    return ops.findings(injected(spark, sf_dir)).select("doc_id", "rank", "id", "severity", "count", _joined("positions", ","), "decoded", "scheme", _joined("samples", "|"), labels)


@query(expected.VERDICTS_SQL)
def scan_verdicts(spark, sf_dir):
    return ops.verdicts(injected(spark, sf_dir))


@query(expected.PAGES_SQL)
def page_verdicts(spark, sf_dir):
    return ops.verdicts(injection.table(spark, sf_dir, "pages"), "page_id", "html")


@query(expected.TURNS_SQL)
def conversation_verdicts(spark, sf_dir):
    return ops.scan_keys(injection.table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "severity", "label", "hidden")


@query(expected.ROLLUP_SQL)
def verdict_rollup(spark, sf_dir):
    return ops.rollup(injected(spark, sf_dir), "lang", "source")


@query(expected.CLEANED_SQL)
def sanitized_texts(spark, sf_dir):
    changes = F.array_join(F.transform("changes", lambda x: F.concat(x["label"], F.lit("="), x["count"])), "|").alias("changes")
    return ops.sanitized(injected(spark, sf_dir)).select("doc_id", "sanitized", changes, "removed", "clean")


@query(expected.VIEWS_SQL)
def text_views(spark, sf_dir):
    return ops.views(injected(spark, sf_dir))


@query(expected.CELLS_SQL)
def noted_cells(spark, sf_dir):
    return ops.cells(injected(spark, sf_dir))


@query(expected.MARKS_SQL)
def hidden_marks(spark, sf_dir):
    return ops.marks(injected(spark, sf_dir)).select("doc_id", "at", "context", _joined("cps", ","), _joined("abbrs", "|"))


@query(expected.ALIGNMENT_SQL)
def mark_alignment(spark, sf_dir):
    """Full outer join of the marks of each text and of the next one of its class, where they differ."""
    m = ops.marks(injected(spark, sf_dir)).select("doc_id", "at", _joined("cps", ","))
    a = m.select(F.col("doc_id").alias("pair"), "at", F.col("cps").alias("a"))
    b = m.select((F.col("doc_id") - injection.CLASSES).alias("pair"), "at", F.col("cps").alias("b"))
    return a.join(b, ["pair", "at"], "full_outer").filter("not (a <=> b)")


@query(expected.COPIES_SQL)
def compared_copies(spark, sf_dir):
    d = injection.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("text_a"))
    found = ops.compare(injection.inject(d).withColumnRenamed("text", "text_b"))
    payloads = F.array_join(F.transform("copy_b.payloads", lambda x: F.concat(x["id"], F.lit("="), x["decoded"])), "|").alias("payloads_b")
    return found.select("doc_id", "relation", "same_bytes", "same_visible", F.size("differences").cast("long").alias("n_differences"), "differing_codepoints", F.col("copy_b.hidden").alias("hidden_b"), F.col("copy_b.signature").alias("signature_b"), payloads)


@query(expected.JSON_SQL)
def json_report_rows(spark, sf_dir):
    return sinks.json_rows(_with_path(injected(spark, sf_dir)))


@query(expected.SARIF_SQL)
def sarif_results(spark, sf_dir):
    return sinks.located(_with_path(injected(spark, sf_dir))).select("path", "rank", "id", "level", "line", "column", "message")


@query(expected.COMMANDS_SQL)
def annotation_commands(spark, sf_dir):
    return sinks.annotations(_with_path(injected(spark, sf_dir)))


@query(f"SELECT id, path, rank, level FROM ({expected.SARIF_SQL}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY path, rank) = 1")
def sarif_rules(spark, sf_dir):
    """The first finding of each id, by path and rank, which a log's rule is made from."""
    return sinks.sarif_rules(_with_path(injected(spark, sf_dir))).select("id", "path", "rank", "level")


@query(f"SELECT path, id, level, line, \"column\", message FROM ({expected.SARIF_SQL})")
def sarif_log_results(spark, sf_dir):
    """The results as the logs hold them that tasks have written, read back line by line."""
    target = f"{reports.shared_folder(spark)}/logs"
    sinks.write_sarif(_with_path(injected(spark, sf_dir)), target, layout="folder")
    lines = spark.read.text(f"file://{target}").filter(F.startswith("value", F.lit('{"ruleId"')))
    schema = "ruleId string, level string, message struct<text: string>, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, startColumn: int>>>>"
    place = "r.locations[0].physicalLocation"
    result = lines.select(F.from_json(F.rtrim("value", F.lit(",")), schema).alias("r"))
    return result.selectExpr(f"{place}.artifactLocation.uri path", "r.ruleId id", "r.level", f"{place}.region.startLine line", f"{place}.region.startColumn column", "r.message.text message")


@query(f"{expected.VERDICTS_CTE} SELECT count(*) AS n_texts, count(*) FILTER (WHERE severity >= 0) AS n_flagged, sum(n_findings)::BIGINT AS n_findings, sum(hidden)::BIGINT AS hidden, max(severity)::INT AS worst FROM v")
def corpus_summary(spark, sf_dir):
    return ops.summary(injected(spark, sf_dir))


_utf16_bytes = "(2 + 2 * (length(text) + length(text) - length(regexp_replace(text, '[\\x{10000}-\\x{10FFFF}]', '', 'g'))))"


@query(f"""SELECT doc_id, coalesce(lang, 'none') AS folder, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16le' ELSE 'utf-16be' END AS encoding,
  (CASE doc_id % 3 WHEN 0 THEN strlen(text) ELSE {_utf16_bytes} END)::BIGINT AS bytes, md5(text) AS text_md5 FROM inj WHERE (CASE doc_id % 3 WHEN 0 THEN strlen(text) ELSE {_utf16_bytes} END) <= {files.MOST_BYTES}""")
def files_read_back(spark, sf_dir):
    """Each text as a file, in a folder of its language and in one of three encodings, found by the folder source and decoded; files of more than 8 MB are not read."""
    root = reports.shared_folder(spark)
    d = injected(spark, sf_dir).withColumns({"encoding": F.get(F.array(*map(F.lit, ("utf-8", "utf-16le", "utf-16be"))), (F.col("doc_id") % 3).cast("int")), "path": F.concat_ws("/", F.lit(root), F.coalesce("lang", F.lit("none")), F.concat("doc_id", F.lit(".txt")))})
    sinks.write_files(d)
    read, _ = files.files(spark, [root], gitignore=False)
    part = lambda n: F.element_at(F.split("path", "/"), n)
    return read.select(F.replace(part(-1), F.lit(".txt")).cast("long").alias("doc_id"), part(-2).alias("folder"), "encoding", F.octet_length("content").cast("long").alias("bytes"), F.md5("text").alias("text_md5"))


# What order says: computed by windows over characters of note, against what is expected of each class.


@query(f"{expected.SQL} SELECT doc_id, id, decoded, scheme FROM f WHERE decoded IS NOT NULL AND id IN ('zero-width', 'variation-selectors')")
def payloads_decoded(spark, sf_dir):
    return cells.payloads(injected(spark, sf_dir))


@query(f"{expected.SQL} SELECT doc_id, severity::INT AS severity, n::INT AS depth, places[1]::INT AS \"offset\" FROM f WHERE id = 'combining-stack'")
def combining_stacks(spark, sf_dir):
    return cells.stack_findings(injected(spark, sf_dir))


@query(f"{expected.SQL} SELECT doc_id, places[1]::INT AS \"offset\", split_part(samples[1], '  [', 1) AS word FROM f WHERE id = 'mixed-script'")
def words_outside_hosts(spark, sf_dir):
    """Words of mixed alphabets; those in lookalike hosts, of which the corpus has some, are none."""
    return spans.mixed_words(injected(spark, sf_dir))


_loud_sql = "CASE WHEN kind IS NULL THEN 2.5 WHEN benign THEN 1.6 " + " ".join(f"WHEN kind = '{kind}' THEN {n}" for kind, n in spans.LOUDNESS.items()) + " END"


@query(f"""{expected.CELLS}, sized AS (SELECT doc_id, length(text) AS size FROM inj), loud AS (SELECT doc_id, i, cp, ({_loud_sql})::DOUBLE AS priority, least(63, floor(i / (size / 64.0::DOUBLE)))::INT AS bucket FROM c JOIN sized USING (doc_id))
SELECT doc_id, bucket, i, cp, priority FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY priority DESC, i) AS nth FROM loud) WHERE nth = 1""")
def spectrum_buckets(spark, sf_dir):
    return spans.spectrum(injected(spark, sf_dir))


@query(f"""{expected.CELLS}, islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, kind, benign ORDER BY i) AS island FROM c WHERE kind IS NOT NULL), runs AS (SELECT doc_id, min(i) AS i, kind, benign, count(*)::INT AS n FROM islands GROUP BY doc_id, kind, benign, island)
SELECT doc_id, i, kind, benign, n, CASE WHEN n >= 64 AND kind <> 'line-break' THEN 48 ELSE n END::INT AS shown, (n - CASE WHEN n >= 64 AND kind <> 'line-break' THEN 48 ELSE n END)::INT AS folded FROM runs""")
def folded_runs(spark, sf_dir):
    return spans.folded(injected(spark, sf_dir))
