"""Prompt-text functions: Column in, Column out, all inside Spark's expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What text cleaning replaces, in this order, once in every round.
CLEANING_RULES = [
    ("```", "."),
    (" {2,}", " "),
    (",{2,}", ","),
    (",(?: ,)+", ","),
    (r"\.{2,}", "."),
    (r"\.(?: \.)+", "."),
    (r",+\.", "."),
    (r"(?:, )+\.", "."),
    (r"\.,+", "."),
    (r"\.(?: ,)+", "."),
]
#: Words that mark a woman or, failing those, a man; found anywhere in a text.
WOMAN_WORDS = ["woman", "women", "female", "lady"]
MAN_WORDS = ["man", "men", "male", "guy", "bloke", "dude"]
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once however often f refers to it."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: What a round changes: a rule's match, blanks that are not single spaces, a blank at an end, equal words side by side.
_TWO_MARKS = "[.,] ?[.,]"
_EQUAL_WORDS = r"(?<!\S)(\S++)(?: \1)+(?!\S)"
_UNDONE = rf"```| {{2,}}|{_TWO_MARKS}|[\s\x1c-\x1f\x85\p{{Z}}&&[^ ]]|^ | $|{_EQUAL_WORDS}"
#: A full stop or a comma that spacing would still part from what follows.
_UNSPACED = r"(?U)(?<!\d)\.(?![\d ]|$)|,(?! |$)"


def _round(text: Column) -> Column:
    """The rules, blanks and equal words once.  All rules but the first two need two marks side by side."""
    (ticks, stop), (blanks, blank), *marks = CLEANING_RULES
    text = F.regexp_replace(F.replace(text, F.lit(ticks), F.lit(stop)), blanks, blank)

    def reduced(t):
        done = t
        for pattern, new in marks:
            done = F.regexp_replace(done, pattern, new)
        return F.when(t.rlike(_TWO_MARKS), done).otherwise(t)

    text = F.regexp_replace(F.regexp_replace(bound(text, reduced), _BLANK, " "), "^ | $", "")
    return F.regexp_replace(text, _EQUAL_WORDS, "$1")


def _settled(text: Column) -> Column:
    """Rounds until one would change nothing.

    A round that changes anything shortens the text (but for the first, which is always made), so there
    are fewer than it has characters; those after the last change only look at a flag.
    """

    def step(state, _):
        open_ = F.struct(_round(state["t"]).alias("t"), F.lit(False).alias("done"))
        return F.when(state["done"], state).when(state["t"].rlike(_UNDONE), open_).otherwise(F.struct(state["t"].alias("t"), F.lit(True).alias("done")))

    def rest(t):
        start = F.struct(t.alias("t"), F.lit(False).alias("done"))
        return F.when(t.rlike(_UNDONE), F.aggregate(F.sequence(F.lit(0), F.length(t)), start, step)["t"]).otherwise(t)

    return bound(_round(text), rest)


def clean_text(text: Column) -> Column:
    """Punctuation spaced, runs of punctuation reduced, adjacent equal words merged, blanks trimmed; twice.

    The rules depend on their order and are repeated until nothing changes.  On a settled text whose marks
    are all spaced the second pass adds blanks only and takes them away again, so it is left out there.
    """

    def once(t):
        t = F.regexp_replace(t, r"(?U)(?<!\d)\.(?!\d)", ". ")
        t = F.replace(F.replace(t, F.lit(","), F.lit(", ")), F.lit("\n"), F.lit(". "))
        return _settled(F.replace(F.replace(t, F.lit("\r"), F.lit("")), F.lit("\t"), F.lit(", ")))

    return bound(once(text), lambda t: F.when(t.rlike(_UNSPACED), once(t)).otherwise(t))


def literal(delimiter: str) -> str:
    """A regular expression for a literal; backslash-n stands for a line feed."""
    return r"\Q" + delimiter.replace("\\n", "\n") + r"\E"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def merge_text(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def merge_delimited(delimiter: str, a: Column, b: Column, merge_delimiter: str) -> Column:
    """Two delimited texts merged item by item; the longer one's rest is kept as it is."""
    if not delimiter:
        raise ValueError("empty delimiter")
    real = delimiter.replace("\\n", "\n")

    def both(x, y):
        x, y = F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))
        return F.concat(x, F.when((x != "") & (y != ""), F.lit(merge_delimiter)).otherwise(""), y)

    return F.array_join(F.zip_with(F.split(a, literal(delimiter), -1), F.split(b, literal(delimiter), -1), both), real)


def batch_prompts(text: Column, delimiter: str) -> Column:
    """Array of the stripped, non-empty parts of a text; one empty prompt where there is none."""
    parts = F.split(text, literal(delimiter), -1) if delimiter else F.array(text)
    parts = F.filter(F.transform(parts, strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))


def frame_of(position: Column, origin_fps: int, result_fps: int, max_frames: int) -> Column:
    """Frame at which the prompt of a position starts, rounded half to even."""
    return F.least(F.bround(position * F.lit(float(origin_fps)) / F.lit(float(result_fps))), F.lit(float(max_frames - 1))).cast("long")


def batch_prompt(text: Column, delimiter: str, origin_fps: int, result_fps: int, max_frames: int) -> Column:
    """The parts of a text as ``"frame" :"prompt"`` lines."""
    lines = F.transform(F.split(text, literal(delimiter), -1), lambda p, i: F.concat(F.lit('"'), frame_of(i, origin_fps, result_fps, max_frames).cast("string"), F.lit('" :"'), p, F.lit('"')))
    return F.array_join(lines, ",\n")


def person_kind(text: Column) -> Column:
    """'woman', 'man' or null, by substring, woman first."""
    low = F.lower(strip(text))
    return F.when(low.rlike("|".join(WOMAN_WORDS)), "woman").when(low.rlike("|".join(MAN_WORDS)), "man")


def people_sentences(women: Column, men: Column) -> tuple[Column, Column]:
    """The sentence that counts people, and the keywords of those that are absent."""
    said = F.concat_ws(
        " ",
        F.when(women > 0, F.concat(F.lit("There are "), women.cast("string"), F.lit(" women in the video."))),
        F.when(men > 0, F.concat(F.lit("There are "), men.cast("string"), F.lit(" men in the video."))),
    )
    absent = F.concat_ws(", ", F.when(women == 0, "woman. women, female, lady"), F.when(men == 0, "man, men, male, guy, bloke, dude, beard, mustache"))
    return said, absent


def replace_text(value: Column, position: Column, find: str, new: str, start: int) -> Column:
    """Literal replacement from a list position on; an empty ``find`` puts ``new`` around every character."""
    done = F.replace(value, F.lit(find), F.lit(new)) if find else F.regexp_replace(value, "(?s)(?=.)|$", new.replace("\\", "\\\\").replace("$", "\\$"))
    return F.when(position >= start, done).otherwise(value)


def add_text(value: Column, position: Column, text: str, start: int, end: int, where: str = "append") -> Column:
    """Text put before or behind the items of a range of positions."""
    grown = F.concat(F.lit(text), value) if where == "prepend" else F.concat(value, F.lit(text))
    return F.when(position.between(start, end), grown).otherwise(value)


def json_values(text: Column) -> Column:
    """Array of the values of a flat JSON object, in their order; null where the text is none."""
    return F.map_values(F.from_json(text, "map<string,string>"))


def json_items(text: Column) -> Column:
    """Array of texts: the items of a JSON list, the values of an object, or a scalar alone.

    True, False and None stand for JSON's literals, nested values stay JSON, and what is no JSON is one
    text as it is; null gives null.
    """

    def shown(v):
        kind, s = F.schema_of_variant(v), F.variant_get(v, "$", "string")
        return F.when(v.isNull() | (kind == "VOID"), "None").when(kind == "BOOLEAN", F.initcap(s)).otherwise(s)

    listed = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<variant>")).when(text.rlike(r"^\s*\{"), F.map_values(F.from_json(text, "map<string,variant>")))
    scalar = bound(F.try_parse_json(text), lambda v: F.when(v.isNotNull(), shown(v)).otherwise(text))
    return F.when(text.isNotNull(), F.coalesce(F.transform(listed, shown), F.array(scalar)))


def to_boolean(text: Column, number: Column | None = None, invert: bool = False) -> Column:
    """Whether anything is left of a value once read as JSON; the strings "0" and "false" count as text.

    ``number``, where given, is the value as a number: 0 counts as nothing.
    """
    t = F.coalesce(strip(text), F.lit(""))
    nothing = t.isin("", "[]", "{}", '""') | t.rlike(r'^\[\s*\]$|^\{\s*\}$|^"\s*"$')
    if number is not None:
        nothing = nothing | F.coalesce(number == 0, F.lit(False))
    return nothing if invert else ~nothing


def math(a: Column, b: Column, operation: str) -> tuple[Column, Column]:
    """(float, truncated integer) of an operation; division by zero and missing numbers give 0."""
    a, b = a.cast("double"), b.cast("double")
    done = {"add": a + b, "subtract": a - b, "multiply": a * b, "divide": F.try_divide(a, b)}[operation]
    value = F.coalesce(done, F.lit(0.0))
    return value, value.cast("bigint")


def colour(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb in lower case."""
    two = lambda x: F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def character_colours(kind: str, i: Column, extras: int = 10) -> Column:
    """Comma-joined colours of character i: an object's, a face's, or a face's with body, clothes and hair."""
    zero, red = F.lit(0), F.lit(255) - i
    if kind == "object":
        return colour(zero, F.lit(255) - i, zero)
    face = colour(red, F.lit(128), F.lit(128))
    if kind == "face":
        return face
    steps = F.sequence(F.lit(0), F.lit(extras - 1))
    return F.concat_ws(
        ",", face, colour(red, zero, zero),
        F.array_join(F.transform(steps, lambda j: colour(red, F.lit(255) - j, zero)), ","),
        F.array_join(F.transform(steps, lambda j: colour(red, zero, F.lit(255) - j)), ","),
    )
