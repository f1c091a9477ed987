"""Licence scan by canonical digests (operator 6).

A text is reduced to what licences have in common: lower case, no copyright lines, no punctuation, one spelling of
equivalent words.  The digest of the whole canonical text is joined with the digests of known licences; so is the digest of each of
its lines, so that one-line notices inside longer texts are found by the same lookup.  A whole text that is not found so is looked up once
more in its bare form: without its title lines, list markers and postal addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.known_licences import KNOWN, MORE, WHOLE

# Patterns on the lower-case text and their replacements, in this order ($n: group n).
RULES = [
    (r"(^|\n)[^\p{L}\p{N}\n]*(copyright[ :,]*(\(c\)|©|<|\[|[0-9])|\(c\) *[<\[0-9]|©|all rights reserved)[^\n]*", "\n"),
    (r"[-'’`]", ""),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r"licenc", "licens"),
    (r"is(e|ed|es|ing|ation|ations)( |\n|$)", "iz$1$2"),
    (r"(behavi|col|fav|hon|lab)our", "$1or"),
    (r"acknowledgement", "acknowledgment"),
    (r"per cent", "percent"),
    (r"copyright owner", "copyright holder"),
]
# Fixed values of the bare form: list markers of the lower-case text; title lines, and places that editions of one text state differently, of the canonical one.
MARKER = (r"(^|\n)[^\p{L}\p{N}\n]*([0-9]{1,2}(\.[0-9]{1,2})*|[a-z]|[ivx]{1,4})[.)][ \t]+", "$1")
_VARIANT = r"([0-9]clause|(two|three|zero) clause|new|modified|revi[sz]ed|simplified|freebsd|libpng|no attribution|variant)"
TITLES = rf"^(((the )?({_VARIANT} )*(mit|expat|isc|zlib|bsd|0bsd)( {_VARIANT})*( licens(e|es))?( (mit|expat|isc|zlib|bsd|0bsd|{_VARIANT}))*|(the )?unlicense|boost software license( version 1 0)?( 17 august 2003| august 17th 2003)?|(the )?apache license( version 2 0)?|(the )?gnu (lesser |library |affero )?general public license|gnu free documentation license|(the )?mozilla public license( version [0-9] [0-9])?|creative commons( legal code)?|(creative commons )?cc0 1 0 universal|version [0-9]( [0-9])?( ([0-9]{{1,2}} )?(january|february|june|november|march) [0-9]{{4}})?|https? www (apache|gnu) org licenses)\n)+"
PLACES = [(r"(51 franklin st(reet)?|59 temple place|675 mass ave)( (fifth floor|suite [0-9]+))? (boston|cambridge) ma [0-9]+( usa)?", ""), (r"https", "http"), (r"http fsf org", ""), (r" +", " ")]
# A word that every whole text of the default table holds (a test says so), whatever its case and hyphens; other texts need no bare form.
LICENSED = "[-'’`]*".join("licen") + "[-'’`]*[cs]|" + "[-'’`]*".join("software")


def canonical_lines(text: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Non-empty canonical lines of a text; none for a null text."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, put in rules:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(put))
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def digest(lines: Column) -> Column:
    """Digest of a canonical text, null where nothing is left of it."""
    return F.when(F.size(lines) > 0, F.md5(F.array_join(lines, " ").cast("binary")))


def bare(text: Column) -> Column:
    """The canonical text without its leading title lines, list markers and places; empty where nothing is left."""
    out = F.array_join(canonical_lines(text, [RULES[0], MARKER, *RULES[1:]]), "\n")
    for pattern, put in [(TITLES, ""), (r"\n", " "), *PLACES]:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(put))
    return F.trim(out)


def bare_digest(text: Column) -> Column:
    """Digest of the bare text; null below 40 words: a notice is not a whole licence."""
    out = bare(text)
    return F.when(F.size(F.split(out, " ")) >= 40, F.md5(out.cast("binary")))


def known_digests(known: DataFrame) -> DataFrame:
    """``(digest, license_id)`` of ``known(license_id, text)``; of texts with equal digests the smallest id holds."""
    return known.select(digest(canonical_lines(F.col("text"))).alias("digest"), "license_id").where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def known_bare_digests(known: DataFrame, whole: list[tuple[str, str]] = []) -> DataFrame:  # noqa: B006
    """``(bare, bare_license_id)`` of the whole texts of ``known`` and of the pairs ``whole`` of identifier and bare digest."""
    table = known.select(bare_digest(F.col("text")).alias("bare"), "license_id").where("bare is not null")
    if whole:
        table = table.unionByName(known.sparkSession.createDataFrame(whole, "license_id string, bare string"))
    return table.groupBy("bare").agg(F.min("license_id").alias("bare_license_id"))


def default_known(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame(KNOWN, "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(doc_id, unit, position, digest, license_id)`` for ``docs(doc_id, text)``.

    Every row gives one row of unit "text", position 0, with the licence that the whole text is (with or without its titles, list markers and places), else null; each of its lines that is a known text
    gives a row of unit "line" with its position among the canonical lines, from 1.  A null, empty or wholly removed text has a null digest and no
    licence.  Repeated rows and null ids are kept, other columns are not read, no rows give no rows.
    """
    text = F.col("text").cast("string")
    bare = bare_digest(text)
    if known is None:
        known, bare = default_known(docs), F.when(F.lower(text).rlike(LICENSED), bare)
        whole = known_bare_digests(known.unionByName(docs.sparkSession.createDataFrame(MORE, known.schema)), WHOLE)
    else:
        whole = known_bare_digests(known)
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(text).alias("lines"), bare.alias("bare"))
    unit = lambda kind, at, code, b: F.struct(F.lit(kind).alias("unit"), at.cast("int").alias("position"), code.alias("digest"), b.alias("bare"))
    each = F.transform("lines", lambda x, i: unit("line", i + 1, F.md5(x.cast("binary")), F.lit(None).cast("string")))
    units = lines.select("doc_id", F.explode(F.concat(F.array(unit("text", F.lit(0), digest(F.col("lines")), F.col("bare"))), each)).alias("u")).select("doc_id", "u.*")
    found = units.join(known_digests(known), "digest", "left").where("unit = 'text' OR license_id IS NOT NULL").join(whole, "bare", "left")
    return found.select("doc_id", "unit", "position", "digest", F.coalesce("license_id", "bare_license_id").alias("license_id"))


def _sql_lines(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern, put in RULES:
        put = put.replace("$", "\\")
        out = "regexp_replace({}, '{}', {}, 'g')".format(out, pattern.replace("'", "''"), "chr(10)" if put == "\n" else f"'{put}'")
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda z: trim(z)), lambda z: z <> '')"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL = f"""WITH known AS (SELECT md5(array_to_string({_sql_lines('t')}, ' ')) AS digest, min(i) AS license_id FROM (VALUES {', '.join(f"({_quote(i)}, {_quote(t)})" for i, t in KNOWN)}) AS v(i, t) GROUP BY 1),
c AS MATERIALIZED (SELECT doc_id, {_sql_lines('text')} AS lines FROM documents),
u AS (SELECT doc_id, 'text' AS unit, 0 AS position, CASE WHEN len(lines) > 0 THEN md5(array_to_string(lines, ' ')) END AS digest FROM c
UNION ALL SELECT doc_id, 'line', CAST(i AS INTEGER), md5(line) FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM c))
SELECT doc_id, unit, position, digest, license_id FROM u LEFT JOIN known USING (digest) WHERE unit = 'text' OR license_id IS NOT NULL"""
