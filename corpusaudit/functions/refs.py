"""Links, locators and paths: schemes, fragments, joins inside an archive, inline payloads."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusaudit.functions.text import WHITESPACE, strip_whitespace

# Schemes that leave the book. The list is data and may be replaced.
EXCLUDED_SCHEMES = ("http", "https", "mailto", "tel", "javascript")


def scheme(href: Column) -> Column:
    """The lower-case scheme of a reference, or an empty string."""
    return F.lower(F.regexp_extract(strip_whitespace(href), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def is_external(href: Column, schemes=EXCLUDED_SCHEMES) -> Column:
    return scheme(href).isin(*schemes)


def is_recorded(href: Column, label: Column, schemes=EXCLUDED_SCHEMES, needs_text=True) -> Column:
    """Whether a reader device keeps this link: inside the book and, by rule, with visible text."""
    inside = ~is_external(href, schemes)
    return inside & (F.length(strip_whitespace(label)) > 0) if needs_text else inside


def path_part(href: Column) -> Column:
    return F.split_part(strip_whitespace(href), F.lit("#"), F.lit(1))


def fragment(href: Column) -> Column:
    return F.regexp_extract(strip_whitespace(href), r"(?s)^[^#]*#(.*)\z", 1)


def percent_decode(text: Column) -> Column:
    """Percent decoding that keeps ``+`` and leaves text with broken escapes as it is."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(F.instr(text, F.lit("%")) == 0, text).otherwise(F.coalesce(decoded, text))


def link_kind(external: Column, resolves: Column, marked: Column) -> Column:
    """What a reader does with a link; the first fitting kind wins."""
    return (
        F.when(external, F.lit("web-link"))
        .when(~resolves, F.lit("dead-link"))
        .when(marked == "noteref", F.lit("footnote-reference"))
        .when(marked == "backlink", F.lit("footnote-back-link"))
        .otherwise(F.lit("cross-reference"))
    )


def link_marker(tokens: Column) -> Column:
    """Marker of a link from its lower-case role and type words; a note reference wins."""
    return (
        F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, NOTEREF_TOKENS))), F.lit("noteref"))
        .when(F.arrays_overlap(tokens, F.array(*map(F.lit, BACKLINK_TOKENS))), F.lit("backlink"))
        .otherwise(F.lit(""))
    )


# Words in ``role`` or ``epub:type`` that mark a note link.
NOTEREF_TOKENS = ("noteref", "doc-noteref")
BACKLINK_TOKENS = ("backlink", "doc-backlink")


def join_path(base: Column, relative: Column) -> Column:
    """Resolve a relative path against the folder of ``base``; NULL where it leaves the root.

    A leading slash starts at the root. Empty and ``.`` parts vanish, ``..`` takes one part
    away, and a path that ends up empty is NULL too.
    """
    folder = F.regexp_extract(base, r"(?s)^(.*/)?[^/]*\z", 1)
    full = F.when(relative.startswith("/"), relative).otherwise(F.concat(folder, relative))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("stack"), F.lit(False).alias("escaped"))

    def step(acc, part):
        depth = F.size(acc["stack"])
        up = part == ".."
        return F.struct(
            F.when(up, F.slice(acc["stack"], F.lit(1), F.greatest(depth - 1, F.lit(0))))
            .otherwise(F.array_append(acc["stack"], part))
            .alias("stack"),
            (acc["escaped"] | (up & (depth == 0))).alias("escaped"),
        )

    return F.aggregate(
        parts,
        start,
        step,
        lambda acc: F.when(
            ~acc["escaped"] & (F.size(acc["stack"]) > 0), F.array_join(acc["stack"], "/")
        ),
    )


def classify_reference(base: Column, href: Column) -> Column:
    """STRUCT(kind, target): same-document, external, unsafe, or in-book with its member name."""
    target = strip_whitespace(href)
    path = F.split_part(target, F.lit("#"), F.lit(1))
    member = join_path(base, percent_decode(path))
    outside = (scheme(target) != "") | target.startswith("//")
    kind = (
        F.when((path == "") & ~outside, F.lit("same-document"))
        .when(outside, F.lit("external"))
        .when(member.isNull(), F.lit("unsafe"))
        .otherwise(F.lit("in-book"))
    )
    return F.struct(kind.alias("kind"), F.when(kind == "in-book", member).alias("target"))


def is_unsafe_member(name: Column) -> Column:
    """Whether an archive member name leaves or avoids the archive root."""
    return (
        (name == "")
        | name.startswith("/")
        | (F.instr(name, F.lit("\\")) > 0)
        | name.rlike(r"(?:^|/)\.\.(?:/|\z)")
    )


def locator_class(src: Column) -> Column:
    """``remote`` (http, https), ``inline`` (data), ``local`` (no scheme) or ``unsupported``."""
    found = scheme(src)
    return (
        F.when(found.isin("http", "https"), F.lit("remote"))
        .when(found == "data", F.lit("inline"))
        .when(
            found.isin("", "file") & ~strip_whitespace(src).rlike(r"(?i)^(?:file:)?//[^/?#]"),
            F.lit("local"),
        )
        .otherwise(F.lit("unsupported"))
    )


def inline_media_type(src: Column) -> Column:
    return F.lower(F.regexp_extract(strip_whitespace(src), r"(?i)^data:([^;,]*)", 1))


def inline_payload(src: Column) -> Column:
    """STRUCT(payload, reason) of an inline reference.

    No comma is one failure, a payload that does not decode another. Without the base64 mark
    the payload is percent-decoded byte by byte, and a broken escape stands for itself.
    """
    target = strip_whitespace(src)
    prefix = F.split_part(target, F.lit(","), F.lit(1))
    body = F.regexp_extract(target, r"(?s)^[^,]*,(.*)\z", 1)
    packed = F.regexp_replace(body, WHITESPACE + "+", "")
    strict = packed.rlike(r"^[A-Za-z0-9+/]*={0,2}\z") & (F.length(packed) % 4 == 0)
    base64 = F.lower(prefix).endswith(";base64")
    # Byte-wise percent decoding: everything becomes hex text first, escapes stay as they are.
    pieces = F.regexp_extract_all(body, F.lit(r"(?s)%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    as_hex = F.transform(
        pieces,
        lambda p: F.when(p.rlike(r"^%[0-9A-Fa-f]{2}\z"), F.substring(p, 2, 2)).otherwise(
            F.hex(F.encode(p, "UTF-8"))
        ),
    )
    payload = (
        F.when(F.instr(target, F.lit(",")) == 0, F.lit(None).cast("binary"))
        .when(base64, F.when(strict, F.try_to_binary(packed, F.lit("base64"))))
        .otherwise(F.unhex(F.array_join(as_hex, "")))
    )
    reason = F.when(
        F.instr(target, F.lit(",")) == 0, F.lit("malformed-inline-reference")
    ).when(base64 & payload.isNull(), F.lit("undecodable-inline-data"))
    return F.struct(payload.alias("payload"), reason.alias("reason"))
