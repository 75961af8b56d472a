"""URL expressions.  Identity for dedup and the written form are two functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import fixed_values as V
from waymark.functions.text import _col, clean_text, strip

_PARTS = r"^(?i)(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _compat_delimiters() -> str:
    """Characters whose compatibility form hides a URL delimiter (e.g. a fullwidth slash)."""
    return "".join(
        chr(p)
        for p in range(0x80, 0x10000)
        if set(unicodedata.normalize("NFKC", chr(p))) & set("/?#@:")
    )


_H16 = "[0-9a-f]{1,4}"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_LS32 = rf"({_H16}:{_H16}|{_OCTET}(\.{_OCTET}){{3}})"


def _ipv6() -> str:
    """IPv6 addresses as RFC 3986 writes them: eight groups, of which "::" stands for one run."""
    forms = [f"({_H16}:){{6}}{_LS32}"]
    for before in range(8):
        lead = "" if before == 0 else f"(({_H16}:){{0,{before - 1}}}{_H16})?"
        after = {6: _H16, 7: ""}.get(before, f"({_H16}:){{{5 - before}}}{_LS32}")
        forms.append(f"{lead}::{after}")
    return f"({'|'.join(forms)})"


_BRACKETED = rf"^\[({_ipv6()}(%[^%\]\[]+)?|v[0-9a-f]+\.[^\]\[]+)\](:[^\]\[]*)?$"
_HIDDEN_DELIMITER = f"[{_compat_delimiters()}]"


def sanitize_url(c: Column | str) -> Column:
    """Normal http(s) URL or null.

    Scheme and authority are lowercased, an empty path becomes ``/``, the
    query stays, the fragment and a bare ``?`` go.  Malformed authorities
    (unbalanced or misplaced brackets, no IPv6 address in them, look-alike
    delimiters) give null.
    """
    stripped = strip(c)
    url = F.regexp_replace(stripped, r"[\t\r\n]", "")
    authority = F.lower(F.regexp_extract(url, _PARTS, 2))
    host = F.regexp_replace(authority, r"^.*@", "")
    path = F.regexp_extract(url, _PARTS, 3)
    query = F.regexp_extract(url, _PARTS, 4)
    brackets_ok = ~authority.rlike(r"[\[\]]") | host.rlike(_BRACKETED)
    valid = stripped.rlike(r"(?i)^https?://") & brackets_ok & ~authority.rlike(_HIDDEN_DELIMITER)
    return F.when(
        valid,
        F.concat(
            F.lower(F.regexp_extract(url, _PARTS, 1)),
            F.lit("://"),
            authority,
            F.when(path == "", F.lit("/")).otherwise(path),
            F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
        ),
    )


def first_url(c: Column | str) -> Column:
    """The first http(s) link in running text, null if there is none."""
    return F.nullif(F.regexp_extract(_col(c), f"(?iU){V.FIRST_URL_PATTERN}", 0), F.lit(""))


def url_key(c: Column | str) -> Column:
    """Dedup identity of a URL: stripped and lowercased as a whole, null if blank."""
    return F.nullif(F.lower(clean_text(c)), F.lit(""))


def query_key(c: Column | str) -> Column:
    """Cache key of a query: SHA-1 hex of its UTF-8 bytes."""
    return F.sha1(F.encode(_col(c), "UTF-8"))


def site_host(site: str) -> str:
    """Host name of a site given as one or as an address, '' if it has none."""
    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", site.strip().lower())
    return re.sub(r":[0-9]*$", "", re.split(r"[/?#]", host)[0].rpartition("@")[2]).strip(".")


def on_sites(c: Column | str, sites: Sequence[str]) -> Column:
    """Whether a URL's host is that of a site or lies below it; false without a host.

    Sites are host names or addresses, of which only the host counts.  ``example.org`` holds
    ``www.example.org``, not ``anexample.org``.  Blank sites are skipped; without any other it is an error.
    """
    hosts = sorted({site_host(s) for s in sites} - {""})
    if not hosts:
        raise ValueError("none of the sites has a host name")
    parts = F.split(F.coalesce(url_host(c), F.lit("")), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.arrays_overlap(above, F.array(*[F.lit(h) for h in hosts]))


def url_host(c: Column | str) -> Column:
    """Lowercase host without user info and port, empty if there is none."""
    authority = F.regexp_extract(F.lower(clean_text(c)), r"^https?://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
