"""Native column forms of URL functions, for URLs that are already serialised (see ``canonical`` for arbitrary input)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkquarry import rules
from linkquarry.functions import canonical, whatwg

_CODEC_CLASS = r"^[!#-;=?-~]*\z"


def is_codec_spelling(url: Column) -> Column:
    return url.rlike(_CODEC_CLASS)


def hostname(url: Column) -> Column:
    """Lower-case host of a serialised URL, brackets of an IPv6 address included."""
    return F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    """The query without its mark; null if the URL has none."""
    return F.nullif(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1), F.lit("")).substr(F.lit(2), F.length(url))


def host_has_suffix(host: Column, suffix: str) -> Column:
    return (host == suffix) | F.endswith(host, F.lit(f".{suffix}"))


def _name(segment: Column) -> Column:
    return F.lower(F.regexp_extract(segment, "^[?]?([^=]*)", 1))


def _any_host(host: Column, suffixes) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | host_has_suffix(host, s)
    return out


def strip_parameters(url: Column, tier: str = "conservative") -> Column:
    """URLs without tracking parameters, for names that hold no escape or plus sign (``needs_kernel`` tells)."""
    parts = F.split(query(url), "&")
    if tier == "conservative":
        gone = lambda s: _name(s).isin(*rules.CONSERVATIVE_PARAMETERS)
    else:
        pattern = "^(?:" + "|".join(p for _, p in rules.AGGRESSIVE_PARAMETERS) + r")\z"
        gone = lambda s: _name(s).isin(*rules.CONSERVATIVE_PARAMETERS) | _name(s).rlike(pattern)
    kept = F.filter(parts, lambda s: ~gone(s))
    head, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)\z", 1)
    out = F.concat(head, F.when(F.size(kept) == 0, F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(kept, "&"))), tail)
    spared = _any_host(hostname(url), rules.ALLOWED_BASE_DOMAINS) if tier == "conservative" else F.lit(False)
    return F.when(query(url).isNull() | spared, url).otherwise(out)


def needs_kernel(url: Column) -> Column:
    """Whether a query's names hold escapes or plus signs, which only the kernel decodes."""
    return F.coalesce(F.exists(F.split(query(url), "&"), lambda s: _name(s).rlike("[%+]")), F.lit(False))


def drop_index_file(url: Column) -> Column:
    """URLs without a trailing index file of the path."""
    names = "|".join(n.replace(".", "[.]") for n in rules.INDEX_FILES)
    return F.regexp_replace(url, rf"(?i)^([a-z]+://[^/?#]*(?:/[^/?#]*)*/)(?:{names})(?=\z|[?#])", "$1")


def product_path(url: Column) -> Column:
    """Shop URLs shortened to their product number."""
    found = F.regexp_extract(path(url), r"(?i)^/(?:[^/]+/)?(?:dp|gp/product)/([A-Z0-9]{10})(?:/.*)?\z", 1)
    head, tail = F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1), F.regexp_extract(url, r"^[^?#]*([?#].*)?\z", 1)
    return F.when(_any_host(hostname(url), rules.AMAZON_DOMAINS) & (found != ""), F.concat(head, F.lit("/dp/"), F.upper(found), tail)).otherwise(url)


def parameter_names(url: Column) -> Column:
    """Lower-case names of the non-empty query segments, escapes left as they are; no query gives an empty list."""
    return F.coalesce(F.transform(F.filter(F.split(query(url), "&"), lambda s: s != ""), _name), F.array().cast("array<string>"))


def signed_scheme(url: Column) -> Column:
    """The signing scheme a URL probably carries, or null; names and path must hold no escapes of unreserved characters."""
    names, where, host = parameter_names(url), path(url), hostname(url)
    has = lambda *n: F.forall(F.array(*map(F.lit, n)), lambda x: F.array_contains(names, x))
    some = lambda n: F.arrays_overlap(names, F.array(*map(F.lit, n)))
    azure = F.lit(False)
    for s in rules.AZURE_HOSTS:
        azure = azure | F.endswith(host, F.lit(s))
    return (
        F.when(where.rlike(rules.CLOUDINARY_PATH), "Cloudinary delivery URL signing")
        .when((host == "maps.googleapis.com") & where.rlike(rules.MAPS_PATH) & has("signature") & some(("key", "client")), "Google Maps Platform URL signing")
        .when(where.rlike(rules.SUPABASE_PATH) & has("token"), "Supabase Storage signed URL")
        .when(has("x-amz-signature") & some(rules.AWS_V4), "AWS Signature Version 4")
        .when(has("x-goog-signature") & some(rules.GOOGLE_V4), "Google Cloud Storage V4 signing")
        .when(has("signature", "key-pair-id") & some(("expires", "policy")), "Amazon CloudFront signing")
        .when(has("awsaccesskeyid", "expires", "signature"), "Amazon S3 Signature Version 2")
        .when(has("googleaccessid", "expires", "signature"), "Google Cloud Storage V2 signing")
        .when(has("sig") & some(rules.AZURE_SAS) & (has("sv") | azure), "Azure Storage shared access signature")
    )


def has_credentials(url: Column) -> Column:
    return url.rlike("^[a-z]+://[^/?#]*[^/?#:@][^/?#]*@")


def preflight_codes(url: Column) -> Column:
    """Codes of the hazards of a URL, credentials first."""
    return F.array_compact(F.array(F.when(has_credentials(url), F.lit("credentials-in-url")), F.when(signed_scheme(url).isNotNull(), F.lit("signed-url-detected"))))


def percent_normalize(url: Column) -> Column:
    """Escapes of unreserved characters decoded and others in upper case, by the kernel."""

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if u is None else canonical.normalize_escapes(u).url for u in batch.to_pylist()], pa.string())

    return run(url)


def classify(url: Column, tags: Column, host_count: Column, popular: Column, adversarial: Column) -> Column:
    """Sorted classes of a serialised URL; null tags count as none."""
    no = lambda c: F.coalesce(c, F.lit(False))
    rest = F.regexp_extract(url, r"^[a-z]+://[^/?#]*(.*)\z", 1)
    opaque = rest.rlike(rules.OPAQUE)
    values = F.transform(F.filter(F.split(query(url), "&"), lambda s: s != ""), lambda s: F.regexp_extract(s, "=(.*)", 1))
    # Twice decoded, where the escapes are sound.
    once = lambda v: F.coalesce(F.try_url_decode(v), v)
    web = r"(?i)^https?://"
    wrapped = no(F.exists(values, lambda v: once(v).rlike(web) | no(F.try_url_decode(F.replace(once(v), F.lit("+"), F.lit("%2B"))).rlike(web))))
    parameters = F.size(parameter_names(url))
    search = F.coalesce(F.length(query(url)) + 1, F.lit(0))
    segments = F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))
    found = F.array(
        F.when(url.rlike(rules.UUID) | url.rlike(rules.HASH), F.lit("uuid-or-hash-bearing")),
        F.when(wrapped, F.lit("wrapped")),
        F.when((parameters >= 4) | (search >= 100), F.lit("query-heavy")),
        F.when(host_count == 1, F.lit("unknown-host")),
        F.when(opaque, F.lit("opaque-id")),
        F.when(popular, F.lit("popular-host")),
        F.when(popular & opaque, F.lit("popular-host-opaque-id")),
        F.when(popular & ~opaque & (segments <= 2), F.lit("popular-host-short-path")),
        F.when(adversarial, F.lit("adversarial")),
    )
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(tags, F.array().cast("array<string>")), F.array_compact(found))))


def byte_size(value: Column) -> Column:
    """Bytes of sizes such as 70GB or 256MiB; null where the text is no size or is out of range."""
    number = F.regexp_extract(value, r"(?i)^([0-9]+(?:[.][0-9]+)?)\s*(?:B|KB|MB|GB|KIB|MIB|GIB)?\z", 1)
    unit = F.upper(F.regexp_extract(value, r"(?i)^[0-9]+(?:[.][0-9]+)?\s*(B|KB|MB|GB|KIB|MIB|GIB)\z", 1))
    factor = F.when(unit == "KB", 1000.0).when(unit == "MB", 1e6).when(unit == "GB", 1e9).when(unit == "KIB", 1024.0).when(unit == "MIB", 1048576.0).when(unit == "GIB", 1073741824.0).otherwise(1.0)
    size = number.try_cast("double") * factor
    return F.when((size > 0) & (F.floor(size) <= 9007199254740991), F.floor(size).cast("bigint"))


def format_bytes(n: int) -> str:
    """A size for people, in binary units."""
    value, unit = float(n), "B"
    for larger in ("KiB", "MiB", "GiB", "TiB"):
        if value < 1024:
            break
        value, unit = value / 1024, larger
    return f"{n} B" if unit == "B" else f"{value:.{1 if value >= 10 else 2}f} {unit}"


def compression_detail(before: Column, after: Column) -> Column:
    """How a length compares with another, in whole percent."""
    share = F.floor(F.abs(before - after) * 100 / before + 0.5).cast("bigint").cast("string")
    return F.when(after < before, F.concat(share, F.lit("% shorter"))).when(after > before, F.concat(share, F.lit("% longer"))).otherwise(F.lit("the same length"))


def change_description(change: Column) -> Column:
    """A sentence on one change of a ledger."""
    saved = F.concat(F.lit(" ("), change["saved_chars"].cast("string"), F.lit(" characters)"))
    kind = change["kind"]
    gone = F.array_join(F.array_except(F.split(F.coalesce(query(change["before"]), F.lit("")), "&"), F.split(F.coalesce(query(change["after"]), F.lit("")), "&")), "&")
    return F.concat(F.when(kind == "removeParam", F.concat(F.lit("Removed parameter "), F.regexp_extract(gone, "^([^=]*)", 1))).when(kind == "unwrap", F.concat(F.lit("Opened the wrapper of "), hostname(change["before"]))).when(kind == "rewrite", F.lit("Shortened the product path")).when(kind == "dropIndexFile", F.lit("Removed the index file")).otherwise(F.lit("Normalised percent escapes")), saved)


def classify_difference(expected: Column, actual: Column) -> Column:
    """How two URLs differ, by the first rule that matches, in one Arrow-batched function."""

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([difference(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    return run(expected, actual)


def _parsed(url: str) -> whatwg.Url | None:
    try:
        return whatwg.parse(url)
    except whatwg.InvalidUrl:
        return None


def _dense(url: whatwg.Url) -> str:
    parts = [p for p in url.path.split("/") if p]
    tail = "/" if parts and url.path.endswith("/") else ""
    return whatwg.Url(**{**url.__dict__, "path": "/" + "/".join(parts) + tail}).href


def _valued(url: str) -> str:
    body, mark, fragment = url.partition("#")
    head, asked, text = body.partition("?")
    return head + asked + "&".join(p if "=" in p else f"{p}=" for p in text.split("&")) + mark + fragment if text else url


def difference(expected: str | None, actual: str | None) -> str | None:
    """The label of a difference; null if either side is null."""
    import re

    if expected is None or actual is None:
        return None
    up = lambda u: re.sub("%[0-9a-fA-F]{2}", lambda m: m[0].upper(), u)
    plus = lambda u: re.sub("%2[bB]", "+", u)
    textual = (
        ("exact", expected == actual),
        ("trailing-slash", f"{expected}/" == actual or f"{actual}/" == expected),
        ("escape-case", up(expected) == up(actual)),
        ("plus-percent-2b", plus(expected) == plus(actual)),
        ("bare-query-or-fragment", expected in (f"{actual}?", f"{actual}#")),
        ("valueless-parameter", _valued(expected) == actual),
    )
    for label, holds in textual:
        if holds:
            return label
    a, b = _parsed(expected), _parsed(actual)
    if a and b:
        if (a.username or a.password) and whatwg.Url(**{**a.__dict__, "username": "", "password": ""}).href == b.href:
            return "userinfo-dropped"
        if _dense(a) == _dense(b):
            return "path-slash-normalization"
        if (a.origin, a.path, a.hash) == (b.origin, b.path, b.hash) and a.search != b.search:
            return "query-changed"
    return "other"
