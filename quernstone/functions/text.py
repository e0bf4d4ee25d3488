"""Text functions as Spark column expressions: trimming, HTML stripping, term extraction, ids and token estimates."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms without weight in any document.
STOPWORDS = tuple(
    "a about above also an and api are as at be been below bool by can contents could description did do "
    "does example field float following for from had has have how in int into is it its label may must "
    "note of on optional or over proto repeated required see should string svc table that the these this "
    "those through to top type types uint use used using value was were what when where which who whom "
    "why will with would ".split()
)
MIN_TERM = 2
_SPACE = r"\t\n\x0B\f\r \x85\xA0  -     　"


def trim_ws(text: Column) -> Column:
    """Without white space (of all Unicode) at both ends."""
    return F.regexp_replace(text, f"^[{_SPACE}]+|[{_SPACE}]+\\z", "")


def is_blank(text: Column) -> Column:
    """Nothing but white space, as trim_ws knows it."""
    return ~text.rlike(f"[^{_SPACE}]")


def strip_html(text: Column) -> Column:
    """Tags go without a trace, six common entities become characters, other entities go."""
    out = F.regexp_replace(text, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(out, "&[a-zA-Z0-9#]+;", "")


def normalize_terms(text: Column) -> Column:
    """Lower-cased ASCII words of two characters or more that aren't stopwords, in order, repeats kept; null text: none."""
    lowered = F.lower(F.replace(strip_html(F.coalesce(text, F.lit(""))), F.lit("İ"), F.lit("i")))
    return F.filter(F.regexp_extract_all(lowered, F.lit("[a-zA-Z0-9_]+"), F.lit(0)), lambda t: (F.length(t) >= MIN_TERM) & ~t.isin(*STOPWORDS))


def approx_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("int")


def short_id(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def path_id(path: str) -> str:
    return hashlib.sha256(os.path.abspath(path).encode()).hexdigest()[:16]


def url_id(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()[:16]


def embedding_text(heading_path: Column, text: Column) -> Column:
    """What is embedded of a chunk: its headings, if any, and its text."""
    return F.when(F.size(heading_path) > 0, F.concat(F.array_join(heading_path, " > "), F.lit(": "), text)).otherwise(text)


def rfc3339(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ssXXX")
