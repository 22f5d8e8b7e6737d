"""Text expressions: masking, SQL normalisation and fingerprints.

Everything here is built from built-in expressions, so it stays inside the JVM.
Word boundaries are spelled out for ASCII, because ``\\b`` of the JVM also looks
at accented letters.  Every replacement is guarded by a cheap test of the text,
so a message only pays for the patterns it can contain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

MASK = "<*>"

_W = "[A-Za-z0-9_]"
_START = f"(?<!{_W})"
_END = f"(?!{_W})"
_B = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"
_S = r"[\t\n\f\r ]"

Guard = Callable[[Column], Column]


def _has(*parts: str) -> Guard:
    def test(text: Column) -> Column:
        found = text.contains(parts[0])
        for part in parts[1:]:
            found = found | text.contains(part)
        return found

    return test


def _digit(text: Column) -> Column:
    return text.rlike("[0-9]")


# The order and the shapes of the text that is masked in a log message.
IPV6_FORMS = (
    r"(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}",
    r"(?:[0-9a-f]{1,4}:){1,7}:",
    r"(?:[0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}",
    r"(?:[0-9a-f]{1,4}:){1,5}(?::[0-9a-f]{1,4}){1,2}",
    r"(?:[0-9a-f]{1,4}:){1,4}(?::[0-9a-f]{1,4}){1,3}",
    r"(?:[0-9a-f]{1,4}:){1,3}(?::[0-9a-f]{1,4}){1,4}",
    r"(?:[0-9a-f]{1,4}:){1,2}(?::[0-9a-f]{1,4}){1,5}",
    r"[0-9a-f]{1,4}:(?::[0-9a-f]{1,4}){1,6}",
    r":(?::[0-9a-f]{1,4}){1,7}",
)
# Repeated groups are possessive: the JVM matches those in a loop, so long text cannot exhaust the stack.
_PATH = r"/[A-Za-z0-9._\-]++(?:/[A-Za-z0-9._\-]++)++"
_DOLLAR = r"(?s)\$[A-Za-z_0-9]*\$.*?\$[A-Za-z_0-9]*\$"
_SINGLE_QUOTED = r"'[^']*+(?:''[^']*+(?='))*+'"
_DOUBLE_QUOTED = r'"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"'
_NUMBER = rf"(?=[0-9]){_START}[0-9]+(?:\.[0-9]+)?{_END}"
#: (when it can apply, pattern, replacement)
MASK_STEPS: tuple[tuple[Guard, str, str], ...] = (
    (_has("$"), _DOLLAR, MASK),
    (_has("'", '"'), f"{_SINGLE_QUOTED}|{_DOUBLE_QUOTED}", MASK),
    (_has("@"), rf"(?i){_B}[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{{2,}}{_END}", MASK),
    (
        _has("-"),
        rf"(?i){_START}[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}{_END}",
        MASK,
    ),
    (lambda t: t.contains("::") | t.like("%:%:%:%:%:%:%:%"), rf"(?i){_B}(?:{'|'.join(IPV6_FORMS)}){_B}", MASK),
    (_has("."), rf"(?=[0-9]){_START}(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){{3}}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9]){_END}", MASK),
    (lambda t: F.length(t) >= 32, rf"(?=[0-9a-fA-F]){_START}[0-9a-fA-F]{{32,64}}{_END}", MASK),
    (_has(":\\"), rf"(?i){_START}[A-Z]:\\[^\t\n\f\r \"'<>|]++", MASK),
    (_has("/"), rf"([ =\"'(:,]){_PATH}", "$1" + MASK),
    (_has("/"), rf"(?:^|[\t\n\f\r]){_PATH}", MASK),
    (_has("="), rf"(?i)(?=[udahrp]){_START}(user|database|dbname|application_name|app|host|remote_host|password|pwd)=([^\t\n\f\r ,]+)", "$1=" + MASK),
    (_digit, _NUMBER, MASK),
)

_BLOCK_COMMENT = r"(?s)/\*.*?\*/"
_LINE_COMMENT = r"--[^\n]*"
STRIP_STEPS: tuple[tuple[Guard, str, str], ...] = (
    (_has("/*"), _BLOCK_COMMENT, " "),
    (_has("--"), _LINE_COMMENT, " "),
    (_has("$"), _DOLLAR, "?"),
    (_has("'"), _SINGLE_QUOTED, "?"),
    (_digit, _NUMBER, "?"),
)
_PUNCTUATION = "=\"'(),.;:\\[\\]{}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """The same value, not deterministic on paper: no filter moves below a projection that has it and repeats its work."""
    return F.when(F.spark_partition_id() >= 0, value)


def _guarded(guard: Guard, pattern: str, replacement: str) -> Callable[[Column], Column]:
    return lambda t: F.when(guard(t), F.regexp_replace(t, pattern, replacement)).otherwise(t)


def _apply(text: Column, steps: tuple[tuple[Guard, str, str], ...]) -> Column:
    for guard, pattern, replacement in steps:
        text = let(text, _guarded(guard, pattern, replacement))
    return text


def _squeeze(text: Column) -> Column:
    loose = let(text, lambda t: F.when(t.rlike(r"[\t\n\f\r]|  "), F.regexp_replace(t, _S + "+", " ")).otherwise(t))
    return F.trim(loose)


def strip_literals(query: Column) -> Column:
    """Statement text without comments and literal values, lower-cased and squeezed."""
    return _squeeze(F.lower(_apply(query, STRIP_STEPS)))


def redact(text: Column) -> Column:
    """Personal data, secrets, addresses, paths and numbers replaced by ``<*>``."""
    return _apply(text, MASK_STEPS)


def mask_message(message: Column) -> Column:
    """Masked form of a log message: redaction, then literal stripping."""
    return _squeeze(F.replace(strip_literals(redact(message)), F.lit("?"), F.lit(MASK)))


def has_fixed_token(masked: Column) -> Column:
    """True when some word keeps text in front of its first mask."""
    marked = F.replace(masked, F.lit(MASK), F.lit("\u0001"))
    return marked.rlike(f"(?:^|{_S})[{_PUNCTUATION}]*[^\\s\u0001{_PUNCTUATION}]")


def template_pattern(masked: Column) -> Column:
    """Template of a masked message: runs of bare masks become one."""
    return F.regexp_replace(masked, r"(^| )<\*>(?: <\*>)+( |$)", "$1<*>$2")


def template_id(pattern: Column) -> Column:
    """Stable id of a template: the first 8 bytes of its SHA-256 as hex text."""
    return F.substring(F.sha2(pattern, 256), 1, 16)


def normalize_name(name: Column) -> Column:
    return F.lower(F.trim(name))


# Type aliases and the stable form they map to.
TYPE_ALIASES = {
    "int4": "integer",
    "int8": "bigint",
    "int2": "smallint",
    "bool": "boolean",
    "float8": "double precision",
    "float4": "real",
    "timestamp with time zone": "timestamptz",
    "timestamp without time zone": "timestamp",
    "character varying": "varchar",
    "bpchar": "character",
}


def normalize_type(data_type: Column) -> Column:
    name = normalize_name(data_type)
    aliases = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(aliases[name], name)


def normalize_sql(definition: Column) -> Column:
    """Definition without comments and a trailing semicolon, squeezed and lower-cased."""
    text = _squeeze(_apply(definition, STRIP_STEPS[:2]))
    return F.lower(F.trim(_apply(text, ((_has(";"), ";$", ""),))))


def fingerprint(value: Column) -> Column:
    """SHA-256 of a normalised definition; empty stays empty."""
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.sha2(normalize_sql(value), 256))


def field_fingerprint(*parts: Column) -> Column:
    """Fingerprint of several attributes taken together."""
    return fingerprint(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def type_family(data_type: Column) -> Column:
    name = F.lower(data_type)
    return (
        F.when(name.contains("int") | name.contains("numeric") | name.contains("decimal"), "number")
        .when(name.contains("char") | (name == "text"), "text")
        .when(name.contains("uuid"), "uuid")
        .when(name.contains("date") | name.contains("time"), "time")
        .otherwise(name)
    )


def access_method(definition: Column) -> Column:
    """Access method named after ``USING`` in an index definition, else empty."""
    return F.regexp_extract(F.lower(definition), r"^.*? using\s+([^\s(]*)", 1)
