"""Functions whose name, order of arguments or edge cases differ in Spark.

Each entry takes the arguments as Spark SQL text and returns Spark SQL text.
"""

from __future__ import annotations

import re
from collections.abc import Callable


#: A name, a literal or a lambda's variable: may stand in a text more than once.
SIMPLE = re.compile(r"(?:[\w$]+|`[^`]*`)(?:\.(?:[\w$]+|`[^`]*`))*|'(?:[^'\\]|\\.)*'|-?\d+(?:\.\d*)?", re.S)
#: Those of them that are no date.
LITERAL = re.compile(r"'(?:[^'\\]|\\.)*'|-?\d+(?:\.\d*)?|NULL|TRUE|FALSE", re.S | re.I)


def bound(make: Callable[..., str], *args: str) -> str:
    """``make`` of arguments that it may use more than once: one that is more than a name or literal is evaluated once, as a lambda's variable."""
    costly = [i for i, x in enumerate(args) if not SIMPLE.fullmatch(x)]
    if not costly:
        return make(*args)
    shown = [f"v_.a{i}" if i in costly else x for i, x in enumerate(args)]
    fields = ", ".join(f"'a{i}', {args[i]}" for i in costly)
    return f"transform(array(named_struct({fields})), v_ -> {make(*shown)})[0]"


def unsigned(text: str) -> str:
    """The text of a date or timestamp without the plus sign that Spark puts before years after 9999."""
    return f"trim(LEADING '+' FROM {text})"


def text_of(x: str, cast: str = "CAST") -> str:
    """A cast to text; ``x`` is a name or literal. Its type is known when the plan is made, and one branch remains."""
    out = f"{cast}({x} AS STRING)"
    return out if LITERAL.fullmatch(x) else f"CASE WHEN typeof({x}) IN ('date', 'timestamp', 'timestamp_ntz') THEN {unsigned(out)} ELSE {out} END"


def concat(*a: str) -> str:
    """Skips nulls; null if all are."""

    def make(*a: str) -> str:
        cast = [text_of(x) for x in a]
        return f"CASE WHEN coalesce({', '.join(cast)}) IS NULL THEN NULL ELSE concat_ws('', {', '.join(cast)}) END"

    return bound(make, *a)


def trunc(x: str, scale: str = "0") -> str:
    """Toward zero; a negative scale truncates before the decimal point."""
    return bound(lambda x, scale: f"(sign({x}) * floor(abs({x}) * power(10, {scale})) / power(10, {scale}))", x, scale)


def code_points(*a: str) -> str:
    each = [f"decode(unhex(lpad(hex({x}), 8, '0')), 'UTF-32')" for x in a]
    return each[0] if len(each) == 1 else concat(*each)


def soundex(s: str) -> str:
    """Letter, then three digits: vowels don't separate equal codes, the first letter's own code is dropped."""
    codes = "'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000'"

    def make(letters: str) -> str:
        tight = f"regexp_replace(regexp_replace(translate({letters}, {codes}), '0', ''), '(.)\\\\1+', '$1')"
        rest = f"CASE WHEN translate(substring({letters}, 1, 1), {codes}) <> '0' THEN substring({tight}, 2) ELSE {tight} END"
        return f"CASE WHEN {letters} = '' THEN '' ELSE concat(substring({letters}, 1, 1), substring(rpad({rest}, 3, '0'), 1, 3)) END"

    return bound(make, f"regexp_replace(upper({s}), '[^A-Z]', '')")


def difference(a: str, b: str) -> str:
    return bound(lambda x, y: "(" + " + ".join(f"CAST(substring({x}, {i}, 1) = substring({y}, {i}, 1) AS INT)" for i in range(1, 5)) + ")", soundex(a), soundex(b))


def regexp_like(s: str, p: str, flags: str | None = None) -> str:
    """Finds the pattern anywhere. Flags i, m, n or s, x; c is the default."""
    if flags is None:
        return f"regexp_like({s}, {p})"
    letters = f"regexp_replace(translate(lower({flags}), 'n', 's'), '[^imsx]', '')"
    return bound(lambda s, p, letters: f"regexp_like({s}, CASE WHEN {letters} = '' THEN {p} ELSE concat('(?', {letters}, ')', {p}) END)", s, p, letters)


def log(a: str, b: str | None = None) -> str:
    if b is None:
        return f"ln({a})"
    return bound(lambda a, b: f"CASE WHEN {a} > 0 AND {a} <> 1 AND {b} > 0 THEN log({a}, {b}) END", a, b)


def json_value(doc: str, path: str) -> str:
    return f"get_json_object({doc}, {path})"


def json_query(doc: str, path: str) -> str:
    return f"to_json(variant_get(try_parse_json({doc}), {path}))"


def grouping(*a: str) -> str:
    if len(a) == 1:
        return f"CAST(grouping({a[0]}) AS INT)"
    return "(" + " + ".join(f"shiftleft(CAST(grouping({x}) AS INT), {len(a) - 1 - i})" for i, x in enumerate(a)) + ")"


UNITS = {"FRAC_SECOND": "SECOND"}


def unit(u: str) -> str:
    u = u.strip().upper().removeprefix("SQL_TSI_")
    return UNITS.get(u, u)


def timestampadd(u: str, n: str, t: str) -> str:
    """A DATE stays one for whole days and more, where it shows as such."""
    out = f"timestampadd({unit(u)}, {n}, {t})"
    is_date = re.match(r"(?i)(DATE\s*'|current_date\b|CAST\(.* AS DATE\)$)", t)
    return f"CAST({out} AS DATE)" if is_date and unit(u) in ("DAY", "WEEK", "MONTH", "QUARTER", "YEAR") else out


def timestampdiff(u: str, a: str, b: str) -> str:
    return f"timestampdiff({unit(u)}, {a}, {b})"


def side_trim(side: str) -> Callable[..., str]:
    return lambda s, chars=None: f"TRIM({side} {chars or repr(' ')} FROM {s})"


CALLS: dict[str, Callable[..., str]] = {
    "CONCAT": concat,
    "LOCATE": lambda a, b, n="1": f"locate({a}, {b}, greatest({n}, 1))",
    "SUBSTRING": lambda s, a, n=None: f"substring({s}, greatest({a}, 1)" + (f", {n})" if n else ")"),
    "SUBSTR": lambda s, a, n=None: f"substring({s}, greatest({a}, 1)" + (f", {n})" if n else ")"),
    "LTRIM": side_trim("LEADING"),
    "RTRIM": side_trim("TRAILING"),
    "CHARACTER_LENGTH": lambda s: f"char_length({s})",
    "INSERT": lambda s, a, n, r: f"overlay({s} PLACING {r} FROM {a} FOR {n})",
    "SPACE": lambda n: f"space(greatest({n}, 0))",
    "REPEAT": lambda s, n: f"repeat({s}, greatest({n}, 0))",
    "ASCII": lambda s: f"ascii(nullif({s}, ''))",
    "UNICODE": lambda s: f"ascii({s})",
    "CHAR": code_points,
    "NORMALIZE": lambda s, form="NFC": f"normalize_text({s}, '{form.strip()}')",
    "SOUNDEX": soundex,
    "DIFFERENCE": difference,
    "REGEXP_LIKE": regexp_like,
    "TRUNC": trunc,
    "TRUNCATE": trunc,
    "SQRT": lambda x: bound(lambda x: f"CASE WHEN {x} >= 0 THEN sqrt({x}) END", x),
    "MOD": lambda a, b: f"try_mod({a}, {b})",
    "POW": lambda a, b: f"power({a}, {b})",
    "LOG": log,
    "RANDOM": lambda *a: f"rand({', '.join(a)})",
    "SIGN": lambda x: f"CAST(sign({x}) AS INT)",
    "COT": lambda x: f"(1 / nullif(tan({x}), 0))",
    "AVERAGE": lambda x: f"avg(CAST({x} AS DOUBLE))",
    "AVG": lambda x: f"avg(CAST({x} AS DOUBLE))",
    "GROUPING": grouping,
    "WEEK": lambda t: f"weekofyear({t})",
    "SECOND": lambda t: f"CAST(floor(second({t})) AS INT)",
    "TIMESTAMPADD": timestampadd,
    "TIMESTAMPDIFF": timestampdiff,
    "LOCALTIME": lambda: "current_time()",
    "LOCALTIMESTAMP": lambda: "localtimestamp()",
    "JSON_VALUE": json_value,
    "JSON_QUERY": json_query,
    "IFNULL": lambda a, b: f"coalesce({a}, {b})",
    "USER": lambda: "current_user()",
    "SYSTEM_USER": lambda: "current_user()",
}
#: Words that stand for a call without parentheses.
BARE = {"LOCALTIME": "current_time()", "LOCALTIMESTAMP": "localtimestamp()", "SYSTEM_USER": "current_user()"}
#: Type names that Spark spells otherwise.
TYPES = {
    "TEXT": "STRING", "CLOB": "STRING", "INT2": "SMALLINT", "INT4": "INT", "INT8": "BIGINT", "FLOAT4": "FLOAT", "FLOAT8": "DOUBLE",
    "NUMBER": "DECIMAL", "NUMERIC": "DECIMAL", "SIGNED": "BIGINT", "INTEGER": "INT", "BOOL": "BOOLEAN", "LONGVARCHAR": "STRING", "DATETIME": "TIMESTAMP",
}
#: Types of the escape form of CONVERT.
CONVERT_TYPES = {"SQL_" + t for t in "BIGINT BINARY BIT BOOLEAN CHAR DATE DECIMAL DOUBLE FLOAT INTEGER LONGVARCHAR NUMERIC REAL SMALLINT TIME TIMESTAMP TINYINT VARBINARY VARCHAR".split()}
#: Other names of the character sets that Spark decodes.
CHARSETS = {"LATIN1": "ISO-8859-1", "ISO88591": "ISO-8859-1", "ASCII": "US-ASCII", "USASCII": "US-ASCII", "UTF8": "UTF-8", "UTF16": "UTF-16", "UTF32": "UTF-32", "UTF8MB4": "UTF-8"}


def charset(name: str) -> str:
    name = name.strip("'\"").upper()
    return CHARSETS.get(name.replace("-", "").replace("_", ""), name)
