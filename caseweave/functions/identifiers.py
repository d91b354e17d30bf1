"""Identifier normalization, validation and content-addressed ids, as Columns."""
from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as V

#: Texts of a batch that are Python strings at a time.
NFKC_SLICE = 256
#: What counts as white space around a cell: all Unicode white space.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                           0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """A text without the white space around it, tabs, returns and no-break spaces included."""
    return F.btrim(text, F.lit(SPACES))


def null_if_no_match(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normalize_phone(raw: Column) -> Column:
    """E.164 form of a national or international phone number, else NULL."""
    compact = F.regexp_replace(strip(raw), V.PHONE_NOISE, "")
    national = null_if_no_match(compact, V.PHONE_NATIONAL, 1)
    return F.coalesce(F.concat(F.lit(V.PHONE_PREFIX), national),
                      null_if_no_match(compact, V.PHONE_INTERNATIONAL))


def normalize_vehicle(raw: Column) -> Column:
    compact = F.regexp_replace(F.upper(strip(raw)), V.GROUPING, "")
    return null_if_no_match(
        compact, V.VEHICLE_FORM)


def normalize_upi(raw: Column) -> Column:
    return null_if_no_match(F.lower(strip(raw)), V.UPI_FORM)


def normalize_account(raw: Column) -> Column:
    digits = null_if_no_match(F.regexp_replace(strip(raw), V.GROUPING, ""), V.ACCOUNT_DIGITS)
    reference = null_if_no_match(F.upper(strip(raw)), V.ACCOUNT_REFERENCE)
    return F.coalesce(digits, reference)


def normalize_ifsc(raw: Column) -> Column:
    return null_if_no_match(F.upper(strip(raw)), V.IFSC_FORM)


def luhn_ok(raw: Column) -> Column:
    """Mod-10 checksum over 13 to 19 digits."""
    digits = F.regexp_replace(raw, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


@F.arrow_udf(T.StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    # Arrow's own utf8_normalize leaves letters decomposed; a batch becomes Python strings a slice at a time
    plain = lambda part: pa.array([v and unicodedata.normalize("NFKC", v) for v in part.to_pylist()], pa.string())
    return pa.concat_arrays([pa.array([], pa.string()), *(plain(values.slice(at, NFKC_SLICE)) for at in range(0, len(values), NFKC_SLICE))])


def nfkc(label: Column) -> Column:
    """Unicode compatibility form.  Spark has no built-in, so only labels with
    non-ASCII characters carry text through the Arrow function; others pass NULL."""
    exotic = F.when(label.rlike(r"[^\x00-\x7F]"), label)
    return F.coalesce(_nfkc(exotic), label)


def squeeze(text: Column) -> Column:
    """Trim and collapse whitespace runs to single spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def strip_honorific(name: Column) -> Column:
    return F.regexp_replace(strip(name), "(?i)" + V.HONORIFICS, "")


def normalized(label: Column, kind: Column) -> Column:
    """Comparison value of a label; compose with ``nfkc`` when labels may be non-ASCII."""
    value = strip(label)
    digits = F.regexp_replace(value, r"\D", "")
    return (F.when(kind == "Phone", F.coalesce(normalize_phone(value), digits))
            .when(kind == "IMEI", digits)
            .when(kind == "Vehicle", F.coalesce(normalize_vehicle(value),
                                                F.regexp_replace(F.upper(value), r"[^A-Z0-9]", "")))
            .when(kind == "UPI", F.coalesce(normalize_upi(value), F.lower(value)))
            .when(kind == "Account", F.coalesce(normalize_account(value), digits))
            .when(kind == "Person", squeeze(F.lower(strip_honorific(value))))
            .otherwise(squeeze(F.lower(value))))


def short_hash(text: Column) -> Column:
    return F.substr(F.sha2(text, 256), F.lit(1), F.lit(24))


def entity_id_from_value(value: Column, kind: Column, scope: Column | None = None) -> Column:
    scope = F.lit("") if scope is None else scope
    key = F.concat(F.when(kind == "Person", scope).otherwise(F.lit("")), F.lit(":"), kind,
                   F.lit(":"), value)
    return F.concat(F.lower(kind), F.lit(":"), short_hash(key))


def entity_id(label: Column, kind: Column, scope: Column | None = None) -> Column:
    """Content-addressed id; names are scoped (to a case), identifiers are global."""
    return entity_id_from_value(normalized(label, kind), kind, scope)


def identity_status(kind: Column, scope: Column) -> Column:
    return (F.when(kind != "Person", F.lit("normalized"))
            .when(scope.startswith("case:"), F.lit("unverified-name-group"))
            .otherwise(F.lit("unresolved")))


def edge_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), short_hash(F.concat_ws(":", *[p.cast("string") for p in parts])))


def document_id(case_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("DOC-"), F.sha2(F.concat(case_id, F.lit(":"), digest), 256))


def norm_header(cell: Column) -> Column:
    return F.regexp_replace(F.lower(cell), "[^a-z0-9]", "")


def alias_list(aliases: list[str] | str) -> list[str]:
    """Header names as a list; a string holds them separated by blanks."""
    return aliases.split() if isinstance(aliases, str) else list(aliases)


def role_position(names: Column, aliases: list[str] | str) -> Column:
    """1-based position of the first header cell in an alias list, 0 when absent."""
    wanted = F.array(*[F.lit(a) for a in alias_list(aliases)])
    hit = F.filter(F.transform(names, lambda n, i: F.when(F.array_contains(wanted, n), i + 1)),
                   lambda p: p.isNotNull())
    return F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit(0)).cast("int")


def map_roles(names: Column, roles: dict[str, list[str]]) -> Column:
    """Header positions of every role, in the role dictionary's order."""
    return F.array(*[role_position(names, aliases) for aliases in roles.values()])


def cell(cells: Column, position: Column) -> Column:
    """Trimmed cell at a 1-based position; absent or out of range gives ''."""
    return F.coalesce(strip(F.try_element_at(cells, F.nullif(position, F.lit(0)))), F.lit(""))


def column_span(cells: Column, position: Column) -> Column:
    """Span of one trimmed cell inside the row text joined with ' | '."""
    raw = F.coalesce(F.try_element_at(cells, F.nullif(position, F.lit(0))), F.lit(""))
    before = F.aggregate(F.slice(cells, F.lit(1), position - 1), F.lit(0),
                         lambda total, c: total + F.length(c) + 3)
    start = before + F.length(raw) - F.length(F.ltrim(raw, F.lit(SPACES)))
    return F.struct(start.alias("start"), (start + F.length(strip(raw))).alias("end"))


def first_truthy(*values: Column) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def valid_call_number(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    return value.rlike(V.CALL_NUMBER_FORM) & digits.between(7, 15)


def valid_case_id(value: Column) -> Column:
    return value.rlike(V.CASE_ID_FORM)


def valid_entity(label: Column, kind: Column) -> Column:
    """Reject noise labels: list words, numbering shapes, malformed identifiers."""
    edge = "[" + "".join("\\" + c for c in V.LABEL_EDGE_PUNCTUATION) + "]"
    clean = F.regexp_replace(strip(label), f"^{edge}+|{edge}+$", "")

    def judge(text):
        low = F.lower(text)
        digits = F.regexp_replace(text, r"\D", "")
        noise = low.isin(*V.STOPWORDS, *V.BOILERPLATE)
        prefixed = low.rlike("^(?:" + "|".join(V.SECTION_PREFIXES) + ")")
        named = (F.length(text) >= 2) & ~noise & ~prefixed & ~text.rlike(V.NUMBERING_SHAPE)
        verdict = (F.when(kind == "IMEI", (F.length(digits) == 15) & luhn_ok(digits))
                   .when(kind == "Phone", normalize_phone(text).isNotNull())
                   .when(kind == "Vehicle", normalize_vehicle(text).isNotNull())
                   .when(kind == "UPI", normalize_upi(text).isNotNull())
                   .when(kind == "Account", (F.length(digits) >= 4)
                         | ((F.length(text) >= 4) & text.rlike(r"\d")))
                   .when(kind == "Person", named & text.rlike("[A-Za-z]") & ~text.rlike(r"\d")
                         & (F.length(text) <= 80))
                   .when(kind == "Organization", named & (F.length(text) <= 100))
                   .otherwise(named))
        return F.coalesce((text != "") & verdict, F.lit(False))

    return F.element_at(F.transform(F.array(clean), judge), 1)
