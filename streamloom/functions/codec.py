"""String and binary codecs as column expressions: percent, hex, dumps, view contexts, variable definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What percent encoding escapes besides controls, DEL and everything outside ASCII.
ESCAPED = ' "#<>&=%'
#: The marks of ASCII that it does not escape, but form encoding does.
KEPT = "!$'()+,/:;?@[\\]^`{|}~"
#: Between a date range's id and what follows; quoted strings of a playlist cannot hold it.
SEPARATOR = '"'
CONTEXT_TYPES = ("SEGMENT", "MAP", "PART", "SCTE35", "ASSET_LIST", "DATERANGE_SCHEDULE")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def percent_encode(value) -> Column:
    """Upper-case escapes of controls, space, ``" # < > & = %``, DEL and non-ASCII bytes; texts without them as they are."""
    value = _col(value)
    # Form encoding escapes more: what it writes for a space is put right, and the other marks are put back.
    form = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for c in KEPT:
        form = F.replace(form, F.lit(f"%{ord(c):02X}"), F.lit(c))
    printable = F.replace(value, F.lit("%"), F.lit("%25"))
    for c in ESCAPED.replace("%", ""):
        printable = F.replace(printable, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(value.rlike(r"[^\x20-\x7e]"), form).otherwise(printable)


def lossy_utf8(data) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(_col(data).cast("string"))


def _decoded_bytes(value: Column) -> Column:
    """The bytes of a text with escapes; broken ones stand for themselves."""
    tokens = F.regexp_extract_all(value, F.lit(r"(?s)%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    as_hex = F.transform(tokens, lambda t: F.when((F.length(t) == 3) & t.startswith("%") & t.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(t, 2, 2)).otherwise(F.hex(F.encode(t, "UTF-8"))))
    return F.unhex(F.array_join(as_hex, ""))


def percent_decode(value) -> Column:
    """Valid escapes become bytes, ``+`` and broken escapes stay, bytes that are no UTF-8 become U+FFFD."""
    value = _col(value)
    # Form decoding is right if nothing is broken: it gives NULL for bad escapes and U+FFFD for bytes that are no UTF-8.
    form = F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    slow = lossy_utf8(_decoded_bytes(value))
    return F.when(~value.contains("%"), value).when(~value.rlike("%(?![0-7][0-9A-Fa-f])"), form).when(F.coalesce(~form.contains("\ufffd"), F.lit(False)), form).otherwise(slow)


def hex_encode(data) -> Column:
    return F.lower(F.hex(_col(data)))


def hex_decode(text) -> Column:
    """Bytes of hex digits; NULL for an odd number of them or any other character."""
    text = _col(text)
    return F.when((F.length(text) % 2 == 0) & ~text.rlike("[^0-9A-Fa-f]"), F.unhex(text))


def hex_dump(data) -> Column:
    """Upper-case bytes parted by a space, groups of four by two, sixteen to a line."""
    cut = lambda text, n: F.regexp_extract_all(text, F.lit(f".{{1,{n}}}"), F.lit(0))
    group = lambda g: F.array_join(cut(g, 2), " ")
    return F.array_join(F.transform(cut(F.hex(_col(data)), 32), lambda line: F.array_join(F.transform(cut(line, 8), group), "  ")), "\n")


def binary_mask(data) -> Column:
    """Each byte as eight binary digits, parted by a space."""
    pairs = F.regexp_extract_all(F.hex(_col(data)), F.lit(".."), F.lit(0))
    return F.array_join(F.transform(pairs, lambda b: F.lpad(F.bin(F.conv(b, 16, 10).cast("long")), 8, "0")), " ")


def data_summary(data) -> Column:
    return F.concat(F.lit("Data<"), F.length(_col(data)).cast("string"), F.lit(">"))


def range_text(start, end) -> Column:
    """``start-end``, or ``-`` without a range."""
    start, end = _col(start), _col(end)
    return F.when(start.isNull() | end.isNull(), "-").otherwise(F.concat(start.cast("string"), F.lit("-"), end.cast("string")))


def range_header(start, end) -> Column:
    return F.concat(F.lit("bytes="), _col(start).cast("string"), F.lit("-"), _col(end).cast("string"))


# --- view contexts


def segment_context(kind: str, url, media_sequence, start, end, part_index=None) -> Column:
    """SEGMENT, MAP or PART context of a resource, as it is before encoding."""
    head = [F.lit(f"{kind},")] + ([_col(part_index).cast("string"), F.lit(",")] if kind == "PART" else [])
    return F.concat(*head, F.concat_ws(",", _col(media_sequence).cast("string"), range_text(start, end), _col(url)))


def scte35_context(message, daterange_id, command) -> Column:
    return F.concat(F.lit("SCTE35,"), _col(command), F.lit(","), _col(daterange_id), F.lit(SEPARATOR), _col(message))


def json_context(kind: str, url, daterange_id) -> Column:
    """ASSET_LIST or DATERANGE_SCHEDULE context."""
    return F.concat(F.lit(f"{kind},"), _col(daterange_id), F.lit(SEPARATOR), _col(url))


def encode_segment(kind: str, url, media_sequence, start, end, part_index=None) -> Column:
    return percent_encode(segment_context(kind, url, media_sequence, start, end, part_index))


def encode_scte35(message, daterange_id, command) -> Column:
    return percent_encode(scte35_context(message, daterange_id, command))


def encode_json(kind: str, url, daterange_id) -> Column:
    return percent_encode(json_context(kind, url, daterange_id))


def _unsigned(text: Column, most: int) -> Column:
    """A whole number of decimal digits, a leading plus allowed, up to ``most``; else NULL."""
    digits = F.when(text.rlike(r"^\+?[0-9]{1,38}$"), F.regexp_replace(text, r"^\+", "").cast("decimal(38,0)"))
    return F.when(digits <= F.lit(str(most)).cast("decimal(38,0)"), digits.cast("decimal(20,0)"))


def _rest(text: Column, separator: str) -> tuple[Column, Column]:
    """What stands before the first separator and behind it (NULL without one)."""
    at = F.instr(text, separator)
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substr(text, at + len(separator)))


def decode_contexts(df: DataFrame, source: str, out: str = "context") -> DataFrame:
    """Adds ``out``, the context of a once percent-decoded column: a struct with unused members NULL and an error code.

    Each stage is a projection of its own, so that no part is worked out twice.
    """
    u64, u32 = (1 << 64) - 1, (1 << 32) - 1
    c = lambda name: F.col(f"_ctx_{name}")

    def stage(frame: DataFrame, **columns: Column) -> DataFrame:
        return frame.withColumns({f"_ctx_{k}": v for k, v in columns.items()})

    def parts(text: Column, separator: str, before: str, after: str) -> dict[str, Column]:
        return dict(zip((before, after), _rest(text, separator), strict=True))

    keep = df.columns
    df = stage(df, **parts(F.col(source), ",", "kind", "body"))
    df = stage(df, **parts(c("body"), ",", "first", "later"))
    df = stage(df, payload=F.when(c("kind") == "PART", c("later")).otherwise(c("body")), tail=F.when(c("kind") == "SCTE35", c("later")).otherwise(c("body")))
    df = stage(df, **parts(c("payload"), ",", "sequence_text", "after"), **parts(c("tail"), SEPARATOR, "id", "target"))
    df = stage(df, **parts(c("after"), ",", "range", "url"))
    df = stage(df, **parts(c("range"), "-", "start_text", "end_text"))
    df = stage(df, sequence=_unsigned(c("sequence_text"), u64), index=_unsigned(c("first"), u32), start=_unsigned(c("start_text"), u64), end=_unsigned(c("end_text"), u64), media=c("kind").isin("SEGMENT", "MAP", "PART"))
    kind, media, part = c("kind"), c("media"), c("kind") == "PART"
    df = stage(
        df,
        error=F.when(~kind.isin(*CONTEXT_TYPES), "UnknownContextType")
        .when(c("body").isNull(), "EmptyContextValue")
        .when(part & c("index").isNull(), "PartIndexParseIntFailure")
        .when(part & c("later").isNull(), "MissingMediaSequencePart")
        .when(media & c("sequence").isNull(), "MediaSequencePartParseIntFailure")
        .when(media & c("range").isNull(), "MissingRangePart")
        .when(media & (c("range") != "-") & (c("start").isNull() | c("end").isNull()), "RangeParseFailure")
        .when(media & c("url").isNull(), "MissingUrlPart")
        .when((kind == "SCTE35") & ~c("first").isin("OUT", "IN", "CMD"), "InvalidCommandType")
        .when((kind == "SCTE35") & c("later").isNull(), "MissingDaterangeId")
        .when((kind == "SCTE35") & c("target").isNull(), "MissingScte35Message")
        .when(kind.isin("ASSET_LIST", "DATERANGE_SCHEDULE") & c("target").isNull(), "MissingAssetListUrl"),
    )
    fine, ranged = c("error").isNull(), media & (c("range") != "-")
    context = F.struct(
        F.when(fine, kind).alias("context_type"),
        F.when(fine & media, c("url")).when(fine & kind.isin("ASSET_LIST", "DATERANGE_SCHEDULE"), c("target")).alias("url"),
        F.when(fine & media, c("sequence")).alias("media_sequence"),
        F.when(fine & part, c("index").cast("long")).alias("part_index"),
        F.when(fine & ranged, c("start")).alias("range_start"),
        F.when(fine & ranged, c("end")).alias("range_end"),
        F.when(fine & ~media, c("id")).alias("daterange_id"),
        F.when(fine & (kind == "SCTE35"), c("first")).alias("command_type"),
        F.when(fine & (kind == "SCTE35"), c("target")).alias("message"),
        c("error").alias("error"),
    )
    return df.select(*(k for k in keep if k != out), context.alias(out))


#: Error code -> text.
CONTEXT_ERRORS = {
    "UnknownContextType": "unknown context type",
    "EmptyContextValue": "context contained no value after type declaration",
    "MissingMediaSequencePart": "missing expected media sequence information",
    "MediaSequencePartParseIntFailure": "media sequence failed to parse",
    "MissingRangePart": "missing expected request range information",
    "RangeParseFailure": "request range information malformed",
    "MissingUrlPart": "missing expected url information",
    "PartIndexParseIntFailure": "part index failed to parse",
    "InvalidCommandType": "invalid scte35 command type",
    "MissingDaterangeId": "missing expected scte35 daterange id",
    "MissingScte35Message": "missing expected scte35 message",
    "MissingAssetListUrl": "missing expected asset list url",
}


# --- variable definitions, as arrays of (name, value) in order of declaration


def encode_definitions(definitions) -> Column:
    """``name=value`` pairs, each percent-encoded, joined by the separator, and all encoded again."""
    pairs = F.transform(_col(definitions), lambda d: percent_encode(F.concat(d["name"], F.lit("="), d["value"])))
    return percent_encode(F.array_join(pairs, SEPARATOR))


def decode_definitions(query_value) -> Column:
    """A map of a definitions parameter; the last of equal names wins, a missing value is empty. NULL if it is no UTF-8."""

    def read(once: Column) -> Column:
        pairs = F.transform(F.split(once, SEPARATOR), lambda p: F.split(percent_decode(p), "=", 2))
        return let(F.transform(pairs, lambda p: F.struct(p[0].alias("name"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("value"))), last_of_each)

    def last_of_each(entries: Column) -> Column:
        return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["name"] == e["name"])))

    value = _col(query_value)
    sound = ~value.contains("%") | F.is_valid_utf8(_decoded_bytes(value).cast("string"))
    return F.when(sound, let(percent_decode(value), read))
