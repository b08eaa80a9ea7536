"""URLs: joining by the WHATWG rules, query parameters, variables, and the links of the viewer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from streamloom.functions import codec
from streamloom.functions.codec import _col
from streamloom.functions.lazy import lazy_udf

DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21", "file": ""}
_ABSOLUTE = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):(.*)", re.S)
_PATH, _QUERY, _FRAGMENT = ' "#<>?^`{}', " \"#<>'", ' "<>`'


def _escape(text: str, unsafe: str) -> str:
    return "".join(c if "\x20" <= c <= "\x7e" and c not in unsafe else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _path(text: str, base: list[str], special: bool) -> list[str]:
    """Segments of a path on top of ``base``, with dot segments resolved."""
    out = list(base)
    parts = re.split(r"[/\\]" if special else "/", text)
    for k, part in enumerate(parts):
        last, plain = k == len(parts) - 1, part.lower().replace("%2e", ".")
        if plain == "..":
            out = out[:-1]
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(_escape(part, _PATH))
    return out


def parse(url: str, base: tuple | None = None) -> tuple | None:
    """(scheme, authority or None, path segments, query or None, fragment or None) of a url, or None if it has none."""
    url = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    rest, _, fragment = url.partition("#")
    fragment = _escape(fragment, _FRAGMENT) if "#" in url else None
    found = _ABSOLUTE.match(rest)
    scheme = found[1].lower() if found else None
    if found and scheme in DEFAULT_PORTS and base and scheme == base[0] and not re.match(r"[/\\]", found[2]):
        rest, found = found[2], None  # a special scheme without slashes, as in "https:x", is relative
    if found:
        rest, special = found[2], scheme in DEFAULT_PORTS
        rest, _, query = rest.partition("?") if "?" in rest else (rest, "", None)
        query = None if query is None else _escape(query, _QUERY)
        if special:
            rest = re.sub(r"^[/\\]*", "//", rest)
        if not rest.startswith("//"):
            return scheme, None, [_escape(rest, "")], query, fragment
        authority, tail = re.match(r"//([^/\\]*)(.*)" if special else r"//([^/]*)(.*)", rest, re.S).groups()
        host = _authority(authority, scheme, special)
        return None if host is None else (scheme, host, _path(tail[1:], [], special) if tail or special else [], query, fragment)
    if not base:
        return None
    scheme, authority, segments, base_query, _ = base
    special = scheme in DEFAULT_PORTS
    rest, query = (rest.split("?", 1)[0], _escape(rest.split("?", 1)[1], _QUERY)) if "?" in rest else (rest, None)
    slash = r"[/\\]" if special else "/"
    if re.match(slash + slash, rest):
        authority, tail = re.match(r"[/\\]{2}([^/\\]*)(.*)", rest, re.S).groups()
        host = _authority(authority, scheme, special)
        return None if host is None else (scheme, host, _path(tail[1:], [], special), query, fragment)
    if re.match(slash, rest):
        return scheme, authority, _path(rest[1:], [], special), query, fragment
    if rest:
        return scheme, authority, _path(rest, segments[:-1], special), query, fragment
    return scheme, authority, segments, base_query if query is None else query, fragment


def _authority(text: str, scheme: str, special: bool) -> str | None:
    login, at, host = text.rpartition("@")
    found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", host)
    if not found or (special and scheme != "file" and not found[1]) or re.search(r"[\s#<>^|%\\]", found[1]):
        return None
    name, port = (found[1].lower() if special else found[1]), found[2]
    if not name.isascii():
        try:
            name = name.encode("idna").decode()
        except UnicodeError:
            return None
    return login + at + name + (f":{int(port)}" if port and port.lstrip("0") != DEFAULT_PORTS.get(scheme) else "")


def serialise(parts: tuple) -> str:
    scheme, authority, segments, query, fragment = parts
    path = "/".join(segments) if authority is None else "".join(f"/{s}" for s in segments)
    return f"{scheme}:" + ("" if authority is None else f"//{authority}") + path + ("" if query is None else f"?{query}") + ("" if fragment is None else f"#{fragment}")


def join(base: str | None, relative: str | None) -> str | None:
    if base is None or relative is None:
        return None
    root = parse(base)
    found = root and parse(relative, root)
    return serialise(found) if found else None


def _resolved(base: pd.Series, relative: pd.Series) -> pd.Series:
    roots: dict = {}
    out = []
    for b, r in zip(base, relative, strict=True):
        if b is None or r is None:
            out.append(None)
            continue
        if b not in roots:
            roots[b] = parse(b)
        found = roots[b] and parse(r, roots[b])
        out.append(serialise(found) if found else None)
    return pd.Series(out, dtype=object)


@lazy_udf("string")
def resolve(base: pd.Series, relative: pd.Series) -> pd.Series:
    """``relative`` against ``base``; NULL where either cannot be parsed."""
    return _resolved(base, relative)


@lazy_udf("string", once=True)
def resolve_once(base: pd.Series, relative: pd.Series) -> pd.Series:
    """The same, for rows that are filtered by what comes of it."""
    return _resolved(base, relative)


@lazy_udf("string", once=True)
def normal(url: pd.Series) -> pd.Series:
    """An absolute url as it is written after parsing: ``resolve`` of nothing against it."""
    known = {u: join(u, "") for u in url.unique() if u is not None}
    return pd.Series([known.get(u) for u in url], dtype=object)


def query_value(url, name: str) -> Column:
    """The raw value of the first ``name=value`` pair of a url's query; pairs without ``=`` are passed over."""
    query = F.regexp_extract(_col(url), r"^[^?#]*\?([^#]*)", 1)
    named = F.filter(F.split(query, "&"), lambda p: F.startswith(p, F.lit(f"{name}=")))
    return F.substr(F.get(named, F.lit(0)), F.lit(len(name) + 2))


def replace_variables(uri, definitions) -> Column:
    """``{$NAME}`` becomes the value of each definition, in order; unknown names stay."""
    return F.aggregate(_col(definitions), _col(uri), lambda text, d: F.replace(text, F.concat(F.lit("{$"), d["name"], F.lit("}")), d["value"]))


# --- links of the viewer


def playlist_link(resolved, definitions) -> Column:
    own = F.when(F.size(_col(definitions)) > 0, F.concat(F.lit("&imported_definitions="), codec.encode_definitions(definitions))).otherwise("")
    return F.concat(F.lit("?playlist_url="), codec.percent_encode(resolved), own)


def context_link(playlist_url, definitions_query, context, encoded: bool = False) -> Column:
    """The playlist itself with a context; the definitions parameter passes as it came. ``encoded``: the url already is."""
    given = F.when(_col(definitions_query).isNotNull(), F.concat(F.lit("&imported_definitions="), _col(definitions_query))).otherwise("")
    base = _col(playlist_url) if encoded else codec.percent_encode(playlist_url)
    return F.concat(F.lit("?playlist_url="), base, given, F.lit("&supplemental_view_context="), _col(context))
