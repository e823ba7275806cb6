"""Text functions as column expressions: words, terms, n-grams, token counts, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shape of a word and what is cut off its ends.
WORD = r"[\p{L}\p{Nd}][\p{L}\p{Nd}_./-]*"
WORD_ENDS = "._/-"
#: Limits in bytes on a term, on a part of an identifier and on an entity.
MAX_TERM, MIN_PART, MAX_ENTITY = 64, 2, 128
#: Fixed value: an ASCII word boundary, as the patterns below mean it.
EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
#: Patterns of heuristic entities. Most begin with what their first character can be, as looking both ways for an edge at
#: every character of a text is most of a search's work.
PROPER = r"(?=\p{Lu})" + EDGE + r"(\p{Lu}[\p{L}0-9]*(?:[ \t]+\p{Lu}[\p{L}0-9]*)*)" + EDGE
ISO_DATE = r"(?=[0-9])" + EDGE + r"([0-9]{4}-[0-9]{2}-[0-9]{2})" + EDGE
WRITTEN_DATE = r"(?=[JFMASOND])" + EDGE + r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?[\t\n\f\r ]+[0-9]{1,2},?[\t\n\f\r ]+[0-9]{4})" + EDGE
PATH = EDGE + r"([0-9A-Za-z_.-]+/[0-9A-Za-z_./-]+|[0-9A-Za-z_]+\.(?:go|js|ts|md|py|json|yaml|yml|sql|sh|html|css|txt))" + EDGE
#: Fixed value: what every path holds, so that other texts needn't be searched for one.
IN_PATH = r"/|\.(?:go|js|ts|md|py|json|yaml|yml|sql|sh|html|css|txt)"
NUMBER = r"(?=[$€£0-9])([$€£][\t\n\f\r ]?[0-9][0-9,]*(?:\.[0-9]+)?|" + EDGE + r"[0-9][0-9,]*(?:\.[0-9]+)?[\t\n\f\r ]?(?:%|ms|s|kb|mb|gb|tb|px|em|rem)" + EDGE + ")"
#: Words that are capitalised only because they begin a sentence.
STARTERS = (
    "the", "a", "an", "this", "that", "these", "those", "it", "we", "i", "you", "they", "he", "she", "there", "here", "if", "when", "while", "for",
    "and", "but", "or", "so", "in", "on", "at", "to", "from", "by", "with", "without", "as", "is", "are", "was", "were", "be", "been", "no", "not",
    "yes", "note", "however", "because", "since", "after", "before", "once", "then", "also", "both",
)
#: Fixed value: a line that begins or ends a block of code.
FENCE = r"(?m)^[^\S\n]*(?:`{3,}[^`\n]*|~{3,}[^\n]*)$"


def trimmed(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Words in order: a letter or digit, then also ``_ - . /``, which are cut off at the ends."""
    # They begin with a letter or digit, so that only their ends can have something to cut off, and none is left empty.
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.rtrim(w, F.lit(WORD_ENDS)))


def terms(text: Column) -> Column:
    """Lower-case index terms in order: words, and the parts of those that are identifiers."""
    short = F.filter(F.transform(words(text), F.lower), lambda w: F.octet_length(w) <= MAX_TERM)
    parts = lambda w: F.filter(F.split(w, "[._/-]"), lambda p: F.octet_length(p) >= MIN_PART)
    return F.flatten(F.transform(short, lambda w: F.when(w.rlike("[._/-]"), F.concat(F.array(w), parts(w))).otherwise(F.array(w))))


def token_count(text: Column) -> Column:
    """Estimated subword tokens: punctuation is one, a word one and one more for every four bytes beyond six."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nd}]+|[^\p{L}\p{Nd}\s]"), F.lit(0))
    cost = lambda w: F.when(F.octet_length(w) > 6, F.lit(1) + F.floor((F.octet_length(w) - 3) / 4)).otherwise(F.lit(1))
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda a, w: a + cost(w).cast("long"))


def folded(text: Column) -> Column:
    """Lower case with white space collapsed, as n-grams see it."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def trigrams(text: Column) -> Column:
    """Set of character trigrams of the folded text; a shorter text is its own only member."""
    x = folded(text)
    many = F.array_distinct(F.regexp_extract_all(x, F.lit("(?s)(?=(...))"), F.lit(1)))
    return F.when(F.length(x) >= 3, many).when(F.length(x) > 0, F.array(x)).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets: 1 if both are empty, 0 if one is."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def query_ngrams(text: Column, most: int = 4) -> Column:
    """Distinct runs of one to ``most`` words, lower-case, without punctuation at the ends of words."""
    w = F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda x: F.regexp_replace(x, r"""^[.,;:!?"'()\[\]{}]+|[.,;:!?"'()\[\]{}]+$""", "")), lambda x: x != "")
    runs = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[runs(n) for n in range(1, most + 1)])))


def without_code(text: Column) -> Column:
    """The text without fenced blocks and with code spans blanked; a span ends with its line at the latest.

    What fence lines part is outside and inside code in turn, and so is what
    backticks part in a line.
    """
    outside = F.array_join(F.filter(F.split(text, FENCE, -1), lambda p, i: i % 2 == 0), "\n")
    blank = lambda line: F.array_join(F.transform(F.split(line, "`", -1), lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(p))).otherwise(p)), " ")
    return F.when(F.contains(text, F.lit("`")) | F.contains(text, F.lit("~~~")), F.array_join(F.transform(F.split(outside, "\n", -1), blank), "\n")).otherwise(text)


def proper_nouns(text: Column) -> Column:
    """Capitalised phrases without a leading article, lone sentence starters and short capitals."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PROPER), F.lit(1)), lambda v: F.regexp_replace(v, r"^(?:The|A|An) [ \t]*", ""))
    lone = lambda v: ~F.contains(v, F.lit(" ")) & F.lower(v).isin(*STARTERS)
    short = lambda v: (F.octet_length(v) < 3) & (v == F.upper(v))
    return F.filter(found, lambda v: (v != "") & ~lone(v) & ~short(v) & (F.octet_length(v) <= MAX_ENTITY))


def entity_array(t: Column) -> Column:
    """Every heuristic entity of a text, code left out, as (kind, value), lower-case, repeats included."""
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.lower(F.trim(v)).alias("value")))
    paths = lambda t: F.when(t.rlike(IN_PATH), F.regexp_extract_all(t, F.lit(PATH), F.lit(1))).otherwise(F.array().cast("array<string>"))
    every = lambda t: F.concat(
        of("date", F.regexp_extract_all(t, F.lit(ISO_DATE), F.lit(1))), of("date", F.regexp_extract_all(t, F.lit(WRITTEN_DATE), F.lit(1))),
        of("path", paths(t)), of("number", F.regexp_extract_all(t, F.lit(NUMBER), F.lit(1))), of("proper", proper_nouns(t)),
    )
    # A variable, as each use of a column would take the code out again.
    found = F.flatten(F.transform(F.array(without_code(t)), every))
    return F.filter(found, lambda e: F.octet_length(e["value"]).between(1, MAX_ENTITY))


def entities(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, value, count): heuristic entities of every row, counted."""
    found = rows.select(id_col, F.explode(entity_array(F.col(text_col))).alias("e")).select(id_col, "e.kind", "e.value")
    return found.groupBy(id_col, "kind", "value").agg(F.count(F.lit(1)).alias("count"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def clip_bytes(text: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` UTF-8 bytes that cuts no character in two."""
    raw = F.encode(text, "UTF-8")
    inside = lambda n: F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")
    size = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).when(F.lit(most <= 0), F.lit("")).otherwise(F.decode(F.substring(raw, F.lit(1), size), "UTF-8"))


#: Layouts of dates in the names of daily notes, with their lengths, in the order in which they are tried; years that count.
DAILY = (("yyyy-MM-dd", 10), ("yyyy_MM_dd", 10), ("yyyyMMdd", 8), ("dd-MM-yyyy", 10), ("MM-dd-yyyy", 10))
YEARS = (1900, 2200)


def daily_date(name: Column) -> Column:
    """ISO date that a note's file name is or begins with, as the first layout that fits reads it; else null."""
    base = F.trim(F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)\z", 1), r"\.(md|markdown)\z", ""))
    days = [F.try_to_timestamp(F.when(F.substring(base, 1, size).rlike("\\A" + layout.replace("yyyy", "\\d{4}").replace("MM", "\\d{2}").replace("dd", "\\d{2}") + "\\z"), F.substring(base, 1, size)), F.lit(layout)) for layout, size in DAILY]
    return F.coalesce(*[F.when(F.year(d).between(*YEARS), F.date_format(d, "yyyy-MM-dd")) for d in days])


#: Fixed value: what follows a text that was cut.
CUT = "\n\n[… truncated]"


def clip_chars(text: Column, most: int) -> Column:
    """The first ``most`` characters, marked if there were more; 0 or less means no limit."""
    return text if most <= 0 else F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT))).otherwise(text)


def slug(name: Column) -> Column:
    """A file name from a name: lower case, runs of other than a-z and 0-9 are one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_number(n: Column) -> Column:
    """A count for display: whole below a thousand, then thousands, with one decimal below ten of them; halves go up."""
    tenths = F.floor((n + 50) / 100)
    small = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k"))
    return F.when(n < 1000, n.cast("string")).when(n < 10_000, small).otherwise(F.concat(F.floor((n + 500) / 1000).cast("string"), F.lit("k")))


def ordered_distinct(values: Column) -> Column:
    """Trimmed values in order, each once, without empty ones."""
    return F.array_distinct(F.filter(F.transform(values, trimmed), lambda v: v != ""))


_HEAD = r"(?s)\A[ \t\r]*---[ \t\r]*\n((?:.*?\n)??)[ \t\r]*---[ \t\r]*(?:\n+|\z)"


def flat_field(text: Column, name: str) -> Column:
    """Value of a ``key: value`` line in the block between two ``---`` lines at a text's start; the last if repeated, else null."""
    pairs = F.filter(F.split(F.regexp_extract(text, _HEAD, 1), "\n"), lambda line: F.trim(F.substring_index(line, ":", 1)) == name)
    pairs = F.filter(pairs, lambda line: F.contains(line, F.lit(":")))
    return F.nullif(trimmed(F.regexp_replace(F.try_element_at(pairs, F.lit(-1)), r"\A[^:]*:", "")), F.lit(""))


def flat_body(text: Column) -> Column:
    """The text without that block."""
    return F.regexp_replace(text, _HEAD, "")


def is_prose(s: Column) -> Column:
    """Readable prose rather than an address, code, a blob or a hash."""
    starts = F.lit(False)
    for prefix in ("http://", "https://", "/", "{", "[", "<"):
        starts = starts | F.startswith(s, F.lit(prefix))
    blob = F.contains(s, F.lit("data:")) | F.contains(s, F.lit("base64,"))
    return (F.octet_length(s) >= 80) & ~starts & ~blob & ~((F.octet_length(s) < 300) & ~F.contains(s, F.lit(" ")))
