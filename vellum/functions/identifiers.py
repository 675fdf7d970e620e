"""Identifiers, links and sources that texts spell out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: identifier patterns; ASCII boundaries by consumed characters, so other engines agree
EIP, SIMD, IACR, ARXIV = r"(?i)(?:eip|erc)[- #]?([0-9]{1,5})", r"(?i)simd[- #]?([0-9]{1,4})", r"([12][0-9]{3}/[0-9]{2,4})", r"([0-9]{4}\.[0-9]{4,5})"
#: fixed values: path and label of sources by identifier prefix
SOURCE_URLS = {"arxiv": "https://arxiv.org/abs/", "iacr": "https://eprint.iacr.org/", "acl": "https://aclanthology.org/", "eip": "https://eips.ethereum.org/EIPS/eip-"}


def extract_ids(c: Column) -> Column:
    """Different identifiers of a text, kind by kind: eip:n, simd:nnnn, iacr:y/n, arXiv numbers."""
    eip = F.transform(F.regexp_extract_all(c, F.lit(EIP), F.lit(1)), lambda n: F.concat(F.lit("eip:"), n.cast("int").cast("string")))
    simd = F.transform(F.regexp_extract_all(c, F.lit(SIMD), F.lit(1)), lambda n: F.concat(F.lit("simd:"), F.lpad(n, 4, "0")))
    iacr = F.transform(F.regexp_extract_all(c, F.lit(IACR), F.lit(1)), lambda n: F.concat(F.lit("iacr:"), n))
    return F.array_distinct(F.concat(eip, simd, iacr, F.regexp_extract_all(c, F.lit(ARXIV), F.lit(1))))


def repo_urls(c: Column, most: int = 5) -> Column:
    """Repository addresses, in lower case, each once, the first `most`."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)(https?://(?:github|gitlab)\.com/[A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+)"), F.lit(1)), F.lower)), 1, most)


def url_parts(c: Column) -> dict[str, Column]:
    """scheme, host and path of an address; empty where missing."""
    return {
        "scheme": F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)),
        "host": F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", 1)),
        "path": F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+(/[^?#]*)", 1),
    }


def valid_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https?://[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?::[0-9]+)?(?:[/?#]\S*)?$"), F.lit(False))


def source_url(doc_id: Column) -> Column:
    """The canonical address of an identifier; null for sources without one."""
    prefix = F.when(doc_id.contains(":"), F.substring_index(doc_id, ":", 1)).otherwise(F.lit("arxiv"))
    rest = F.when(doc_id.contains(":"), F.regexp_replace(doc_id, "^[^:]*:", "")).otherwise(doc_id)
    base = F.lit(None).cast("string")
    for k, v in SOURCE_URLS.items():
        base = F.when(prefix == k, F.lit(v)).otherwise(base)
    return F.concat(base, rest)
