"""Known licences by canonical digests of entire texts.

A text is made canonical in this order:

1. Copyright statements that are part of licences go, wherever a line ends in them.
2. Lines that are copyright statements as a whole go.  A line that merely begins
   like one, as a wrapped sentence or a lettered clause does, stays.
3. Marks of list items go: a number or letter with its full stop or parenthesis where
   a new sentence begins.
4. Lower case, punctuation and white space as one blank, equivalent spellings as one.
5. A first line that is only the title of a licence goes, if something follows.

What is left is one stream of words, so it does not matter where lines were broken.
Its SHA-256 is joined by hash to the digests of known licences, made canonical in the
same way.  The digests of single canonical lines are joined by hash to known texts
and notices.  Nothing is searched inside: a match is one of the entire text or line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import materialize
from .common import whole_text
from .license_texts import EQUIVALENT, NOTICES, TEXTS, TITLES

# Patterns are written in what Java's and RE2's regular expressions have in common.
# Statements inside published licences, and their forms to fill in.
OWN_STATEMENTS = (
    r"(?i)copyright\s+\(c\)\s+[0-9][0-9,\s]*free\s+software\s+foundation,?\s+inc\.?,?(?:\s+<https?://fsf\.org/>)?"
    r"|copyright\s+(?:\(c\)\s+)?[<\[{(]?(?:year|yyyy|19yy)[>\]})]?,?\s+[<\[{(]?(?:your\s+name|name\s+of\s+(?:the\s+)?(?:copyright\s+)?(?:author|owner))[>\]})]?\.?"
    r"|copyright\s+\(c\)\s+_[_\s.]*all\s+rights\s+reserved\.?"
)
_MARK = r"(?:copyright|\([cC]\)|©|&copy;)"
_REST = r"\S*(?:[ \t]+\S+){0,%d}[ \t\r]*\z"
_NAME = r"\p{Lu}[\p{L}\p{N}.,'&-]*"
_BEFORE = r"^[^\p{L}\p{N}(©&]*"
COPYRIGHT_LINE = "|".join(
    [
        # The mark and a year.
        _BEFORE + rf"(?i:(?:(?:portions|{_MARK})[ \t:,.-]*){{1,6}})[<\[{{(]?(?:(?:19|20)[0-9][0-9]|(?i:year|yyyy))" + _REST % 20,
        # Two marks and a holder; the sign and a holder.
        _BEFORE + r"(?i:copyright)[ \t:,.-]*(?:\([cC]\)|©|&copy;)" + _REST % 12,
        _BEFORE + r"(?:©|&copy;)" + _REST % 12,
        # The word and a name: capitals and what may stand between them.
        _BEFORE + rf"Copyright[ \t:,]+(?:(?:by|the|The)[ \t]+){{0,2}}{_NAME}(?:[ \t]+(?:{_NAME}|and|of|the|<\S+>|\(\S+\))){{0,12}}[ \t\r]*\z",
        # The letter and at most four names.
        r"^[^\p{L}\p{N}(]*\([cC]\)[ \t]+(?:\p{Lu}(?:\.|[\p{L}\p{N}'-]*)[ \t]+){0,3}\p{Lu}(?:[\p{L}\p{N}'-]*[\p{L}\p{N}])?[ \t\r]*\z",
        r"^[^\p{L}\p{N}]*(?i:all rights reserved)[^\p{L}\p{N}]*\z",
    ]
)
# Sentences about copyright.
NO_COPYRIGHT_LINE = (
    r"^[^\p{L}]*(?i:copyright)[^\p{L}\p{N}]+(?i:holders?|owners?|notices?|licen[cs]es?|laws?|statements?|interests?|and|act)"
    r"(?:[^\p{L}]|\z)"
)
# Runs of white space within a line, and several line ends; made one blank and two line ends first.
BLANKS, EMPTY_LINES = r"[ \t\r\f\x0B]+", r"\n[ \n]*\n"
# Marks of list items behind the end of a sentence, a blank line, "and" or "or", on the same line or the next.
# Repetitions of groups are bounded, so that no text, whatever its length, makes a deep search.
ITEM = (
    r"(^|[.;:,!?\"] ?[ \n]|[ \n](?:and|or|AND|OR) ?[ \n]|\n\n)"
    r" ?\n? ?(?:[*•·-]* ?\(?(?:[0-9]{1,2}|[a-zA-Z]|[ivx]{1,4})[.)] ?[ \n] ?){1,3}"
)


def _plain(line: Column) -> Column:
    """Lower-cased words with one blank between them, equivalent spellings as one."""
    # A blank on both sides makes every word a whole word; doubled so that neighbours do not share one.
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    return _same_spelling(plain)


def _same_spelling(doubled: Column) -> Column:
    for spelling, same in EQUIVALENT.items():
        doubled = F.replace(doubled, F.lit(f" {spelling.replace(' ', '  ')} "), F.lit(f" {same.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(doubled, " +", " "))


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that have words."""
    lines = F.split(F.regexp_replace(text, OWN_STATEMENTS, " "), "\n", -1)
    kept = F.filter(lines, lambda line: ~line.rlike(COPYRIGHT_LINE) | line.rlike(NO_COPYRIGHT_LINE))
    joined = F.array_join(F.transform(kept, lambda line: F.regexp_replace(line, BLANKS, " ")), "\n")
    marked = F.regexp_replace(F.regexp_replace(joined, EMPTY_LINES, "\n\n"), ITEM, "$1\n")
    return F.filter(F.transform(F.split(marked, "\n", -1), _plain), lambda line: line != "")


def canonical_text(lines: Column) -> Column:
    """The canonical words of a whole text, from its canonical lines."""
    titled = (F.size(lines) > 1) & F.get(lines, F.lit(0)).isin(TITLES)
    words = F.array_join(F.when(titled, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).otherwise(lines), " ")
    # Spellings of several words may stand on two lines.
    return _same_spelling(F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def known_licenses(spark: SparkSession, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """``license_id`` and ``digest`` of all known texts and notices; ``extra`` adds more of them."""
    rows = [(name, text) for name, text in TEXTS.items()]
    rows += [(name, text) for more in (NOTICES, extra or {}) for name, texts in more.items() for text in texts]
    table = spark.createDataFrame(rows, "license_id string, text string")
    whole = canonical_text(canonical_lines(F.col("text")))
    # A text known under two names belongs to the first of them.
    return table.select("license_id", whole.alias("_whole")).where("_whole != ''").groupBy(
        _digest(F.col("_whole")).alias("digest")
    ).agg(F.min("license_id").alias("license_id"))


def scan(
    docs: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``digest``, ``license_id``, ``notices``.

    ``digest`` is that of the canonical text, ``license_id`` the licence whose entire
    text it is (null: none), ``notices`` the licences, sorted, whose text or notice
    is an entire line.  Null, empty and otherwise blank texts share the digest of the
    empty text and match nothing.  Repeated rows each get their own result.  Other
    columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    # Written, so that its size tells Spark whether to broadcast it.
    known = materialize(known_licenses(docs.sparkSession) if known is None else known, "known")
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(f"`{id_column}`").alias("_id"),
        canonical_lines(whole_text(f"`{text}`")).alias("_lines"),
    )
    # Half a digest per line is enough to be told from all others.
    halves = F.array_distinct(F.transform("_lines", lambda line: _half(_digest(line))))
    rows = materialize(
        rows.select("_row", "_id", _digest(canonical_text(F.col("_lines"))).alias("digest"), halves.alias("_lines")), "digests"
    )
    lines = rows.select("_row", F.explode("_lines").alias("_line"))
    # Of all lines only those that are known are shuffled, when the known digests are few enough to be broadcast.
    named = (
        lines.join(known.select(_half(F.col("digest")).alias("_line"), F.col("license_id").alias("_name")), "_line")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set("_name")).alias("notices"))
    )
    whole = rows.drop("_lines").join(known.select("digest", "license_id"), "digest", "left")
    return whole.join(named, "_row", "left").select(
        F.col("_id").alias(id_column),
        "digest",
        "license_id",
        F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
    )


def _half(digest: Column) -> Column:
    return F.unhex(F.substring(digest, 1, 32))


def comparison_sql() -> str:
    """The registered query for another engine."""

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def spelled(value: str) -> str:
        for spelling, same in EQUIVALENT.items():
            value = f"replace({value}, ' {spelling.replace(' ', '  ')} ', ' {same.replace(' ', '  ')} ')"
        return f"trim(regexp_replace({value}, ' +', ' ', 'g'))"

    plain = spelled("' ' || regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', '  ', 'g') || ' '")
    rows = [(name, text) for name, text in TEXTS.items()]
    rows += [(name, text) for name, texts in NOTICES.items() for text in texts]
    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in rows)
    titles = ", ".join(map(quoted, TITLES))
    return f"""
with given as (
  select doc_id as id, '' as name, coalesce(text, '') as text from documents
  union all select row_number() over () as id, name, text from (values {values}) v(name, text)
), numbered as (select row_number() over () as n, * from given
), cut as (
  select n, string_split(regexp_replace(text, {quoted(OWN_STATEMENTS)}, ' ', 'g'), chr(10)) as lines from numbered
), kept as (
  select n, array_to_string([regexp_replace(x, {quoted(BLANKS)}, ' ', 'g') for x in lines if not regexp_matches(x, {quoted(COPYRIGHT_LINE)})
                             or regexp_matches(x, {quoted(NO_COPYRIGHT_LINE)})], chr(10)) as text from cut
), marked as (
  select n, string_split(regexp_replace(regexp_replace(text, {quoted(EMPTY_LINES)}, chr(10) || chr(10), 'g'),
                                        {quoted(ITEM)}, '\\1' || chr(10), 'g'), chr(10)) as lines from kept
), split_lines as (
  select n, unnest(lines) as line, generate_subscripts(lines, 1) as k from marked
), lines as (
  select n, row_number() over (partition by n order by k) as k, line, count(*) over (partition by n) as size
  from (select n, k, {plain} as line from split_lines) where line <> ''
), whole as (
  select n, coalesce(string_agg(line, ' ' order by k) filter (k > 1 or size = 1 or line not in ({titles})), '') as words
  from numbered left join lines using (n) group by n
), spelled as (
  select n, {spelled("' ' || replace(words, ' ', '  ') || ' '")} as canonical from whole
), known as (
  select canonical, min(name) as name from spelled join numbered using (n) where name <> '' and canonical <> '' group by 1
), noticed as (
  select n, string_agg(distinct known.name, ',' order by known.name) as notices
  from lines join known on lines.line = known.canonical group by n
)
select id as doc_id, sha256(spelled.canonical) as digest, known.name as license_id, coalesce(notices, '') as notices
from numbered join spelled using (n) left join known using (canonical) left join noticed using (n)
where numbered.name = ''
"""
