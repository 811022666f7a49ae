"""Column expressions over text: regex dialect, normalisation and the scalars of spreadsheet cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as browsers' regexes have it, as the content of a character class.
WHITE_SPACE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: A word edge between ASCII word characters; Java's own \b also takes accented letters for such.
WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: No letter, digit or underscore of any script on the other side.
NO_WORD_BEFORE, NO_WORD_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mapped(items: Column, step: str) -> Column:
    """transform of an array by a lambda in SQL ("x -> ..."): one call to the JVM where an expression built up from
    Columns takes one for each node."""
    return F.call_function("transform", items, F.expr(step))


def let_sql(value: Column, body: str) -> Column:
    """SQL over `v`, which is value, evaluated once."""
    return F.element_at(mapped(F.array(value), f"v -> {body}"), 1)


def bound(name: str, value: str, body: str) -> str:
    """SQL of body with a name for the value of another SQL expression."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(values: str, add: Callable[[str, str], str], zero: str) -> str:
    """SQL for what lies before each of an array's values, added up from the left (add must be associative, zero
    its identity). In blocks of about the root of their number, as an array that grows by one is copied each time."""

    def fold(items: str, of: str) -> str:
        start = f"named_struct('sum', {zero}, 'before', slice(array({zero}), 1, 0))"
        return f"aggregate({items}, {start}, (acc, x) -> named_struct('sum', {add('acc.sum', of)}, 'before', array_append(acc.before, acc.sum)))"

    size = f"greatest(cast(ceil(sqrt(size({values}))) AS int), 1)"
    blocks = bound("width", size, f"transform(sequence(0, cast(floor((size({values}) - 1) / width) AS int)), j -> slice({values}, j * width + 1, width))")
    inner = f"transform({blocks}, block -> {fold('block', 'x')})"
    shifted = f"flatten(transform(inner_, (y, j) -> transform(y.before, w -> {add('get(outer_, j)', 'w')})))"
    whole = bound("inner_", inner, bound("outer_", fold("inner_", "x.sum") + ".before", shifted))
    return f"CASE WHEN size({values}) = 0 THEN slice(array({zero}), 1, 0) ELSE {whole} END"


#: Texts are cut into blocks of 2^8 characters where many places of one are read: a place is then found without a walk
#: through all that stands before it.
_BLOCK_BITS = 8


def blocks(text: str) -> str:
    """SQL for the blocks of a text."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{1 << _BLOCK_BITS}}}', 0)"


def cut(start: str, end: str, of: str = "b") -> str:
    """SQL for the characters from start to end, of the blocks of a text."""
    first = f"shiftright({start}, {_BLOCK_BITS})"
    some = f"array_join(slice({of}, {first} + 1, shiftright({end}, {_BLOCK_BITS}) - {first} + 1), '')"
    return f"substr({some}, {start} - shiftleft({first}, {_BLOCK_BITS}) + 1, {end} - {start})"


def dialect(pattern: str, edge: str = WORD_EDGE, flags: str = "") -> str:
    r"""A pattern with \b, \s and \S as browsers read them, for Java; with edge=r"\b" for RE2."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b":
            out.append(edge)
        elif two == r"\s":
            out.append(WHITE_SPACE if in_class else f"[{WHITE_SPACE}]")
        elif pattern[i] == "\\":
            out.append(two)
        else:
            in_class = pattern[i] == "[" or (in_class and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
            continue
        i += 2
    return (f"(?{flags})" if flags else "") + "".join(out)


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\z", "")


def normalised(text: Column) -> Column:
    """The value that occurrences share: lower-cased, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), f"[{WHITE_SPACE}]+", " "))


def value_key(type_: Column, text: Column) -> Column:
    return F.concat(type_, F.lit(":"), normalised(text))


def without_end_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"[.,;:]+\z", "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)\z", 1))


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+\z", "")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def needs_model(text: Column) -> Column:
    """A text without letter or digit is never worth a model's time."""
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def normalise_caps(text: Column) -> Column:
    """All-capital stretches between newlines and tabs as capitalised words, of the same length.

    A stretch changes if it has four or more capitals and no small letter; of each run of letters all
    but the first are lower-cased, except letters whose small form has another length."""

    def word(run: Column) -> Column:
        rest = F.transform(F.split(run.substr(F.lit(2), F.length(run)), ""), lambda c: F.when(F.length(F.lower(c)) == F.length(c), F.lower(c)).otherwise(c))
        return F.when(run.rlike(r"^\p{L}"), F.concat(run.substr(1, 1), F.array_join(rest, ""))).otherwise(run)

    def stretch(s: Column) -> Column:
        capitals = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
        return F.when((capitals >= 4) & ~s.rlike(r"\p{Ll}"), F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), word), "")).otherwise(s)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"[^\n\t]+|[\n\t]+"), F.lit(0)), stretch), "")


# Scalars of spreadsheet cells -----------------------------------------------------------------


def column_label(n: Column) -> Column:
    """0 to A, 25 to Z, 26 to AA, up to three letters."""
    n = n.cast("int")
    letter = lambda x: F.char(F.lit(65) + x.cast("int"))
    one, two = letter(n), F.concat(letter(F.floor((n - 26) / 26)), letter((n - 26) % 26))
    three = F.concat(letter(F.floor((n - 702) / 676)), letter(F.floor((n - 702) / 26) % 26), letter((n - 702) % 26))
    return F.when(n < 26, one).when(n < 702, two).otherwise(three)


def cell_address(address: Column) -> Column:
    """"BC12" to struct(row, col), both from 0; null if it is no address."""
    letters, number = F.upper(F.regexp_extract(address, r"^\$?([A-Za-z]{1,3})\$?(\d+)\z", 1)), F.regexp_extract(address, r"^\$?([A-Za-z]{1,3})\$?(\d+)\z", 2)
    col = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)
    return F.when(letters != "", F.struct((number.cast("int") - 1).alias("row"), (col - 1).alias("col")))


def excel_serial_date(serial: Column, date1904: Column) -> Column:
    """ISO text of a day number, with the time after a space if it is no whole number. A time is rounded to milliseconds, and
    what is left of a second is cut off; 60 of the 1900 system is a day that never was, so numbers from it on count one less."""
    days = serial - F.when(~date1904 & (serial >= 60), 1).otherwise(0)
    epoch = F.when(date1904, F.unix_date(F.to_date(F.lit("1904-01-01")))).otherwise(F.unix_date(F.to_date(F.lit("1899-12-31"))))
    ms = epoch.cast("long") * 86_400_000 + F.floor(days * 86_400_000 + 0.5)
    moment = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=F.floor(ms / 1000).cast("decimal(18,6)"))
    return F.when(serial == F.floor(serial), F.date_format(moment, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))


def is_date_format(format_id: Column, code: Column) -> Column:
    """Whether a number format shows a date: the built-in ids, or a code with date letters outside quotes and brackets."""
    bare = F.regexp_replace(code, r'"[^"]*"|\[[^\]]*\]|\\.', "")
    return format_id.between(14, 22) | format_id.between(45, 47) | F.coalesce(bare.rlike(r"(?i)[ymdhis]"), F.lit(False))


def zero_pad(value: Column, code: Column) -> Column:
    """A whole number under a format of zeros alone, padded to its length."""
    text = value.cast("string")
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), F.length(code) - F.length(text))), text)
    return F.when(code.rlike(r"^0{2,}\z") & text.rlike(r"^\d+\z"), padded).otherwise(text)


def keeps_text(raw: Column) -> Column:
    """Whole numbers beyond 2^53 - 1 stay text, as a double would change them."""
    return raw.rlike(r"^-?\d+\z") & (F.abs(raw.cast("decimal(38,0)")) > F.lit(9007199254740991).cast("decimal(38,0)"))


def decode_x(text: Column) -> Column:
    """_xHHHH_ escapes of spreadsheets as their characters."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)_x[0-9A-Fa-f]{4}_|(?:(?!_x[0-9A-Fa-f]{4}_).)+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^_x[0-9A-Fa-f]{4}_\z"), F.decode(F.unhex(p.substr(3, 4)), "UTF-16BE")).otherwise(p)), "")


def escape_xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


# What is replaced in Office XML, and by what.
SCRUBBED = (
    (r'(w:author|w15:author)="[^"]*"', '$1="Redacted"'),
    (r'(w:initials)="[^"]*"', '$1="R"'),
    (r'(w15:userId)="[^"]*"', '$1=""'),
    (r"<(dc:creator|cp:lastModifiedBy|dc:title|dc:subject|dc:description|cp:keywords|Company|Manager)>[^<]*</\1>", "<$1></$1>"),
    (r"(<vt:lpwstr>)[^<]*(</vt:lpwstr>)", "$1$2"),
)
# End of fixed values.


def scrub_office_xml(xml: Column) -> Column:
    """Office XML without names of authors and editors, document properties and custom properties."""
    for pattern, new in SCRUBBED:
        xml = F.regexp_replace(xml, pattern, new)
    return xml


def rounded_score(score: Column) -> Column:
    """A score as it is kept: four digits, halves up."""
    return F.floor(score * 10_000 + 0.5) / 10_000


def neutralised(value: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets an apostrophe; plain numbers do not."""
    number = value.rlike(r"^[+-]?(\d[\d,]*)?(\.\d+)?([eE][+-]?\d+)?\z") & (value != "")
    formula = value.rlike(rf"^[{WHITE_SPACE}]*[=+\-@]") | value.rlike(r"^[\t\r\n]")
    return F.when(number, value).when(formula, F.concat(F.lit("'"), value)).otherwise(value)
