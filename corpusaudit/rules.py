"""Rules as data: requirements, activations and observations of reading devices.

Every value here is a fixed value of a device or of the shared vocabulary. Other devices are
other rows; the operators take them as arguments.
"""

from typing import NamedTuple

from corpusaudit.functions.refs import EXCLUDED_SCHEMES  # noqa: F401


class Requirement(NamedTuple):
    id: str
    unit: str | None = None
    enforced: int | None = None
    observed: int | None = None
    failure_mode: str = "unknown"
    authority: str = "report"
    declared: str | None = None  # a verdict the profile states itself


# The limit of recorded links per block is stated by the device's tests: a crash above 128, and
# 256 seen on one device.
REQUIREMENTS = (
    Requirement("recorded-links-per-block", "recorded links", 128, 256, "crash", "refuse"),
    Requirement("footnote-href-length", "bytes", 96, None, "silent-misdirection", "refuse"),
    Requirement("anchors-per-chapter", "anchors", 1024, None, "graceful-degradation", "report"),
    Requirement(
        "footnotes-per-screen",
        "recorded links per rendered screen",
        None,
        16,
        "silent-loss",
        "report",
        "unevaluable",
    ),
    Requirement("image-media-type", None, None, None, "visible-loss", "report"),
    Requirement("png-decoding", None, None, None, "visible-loss", "report"),
    Requirement("jpeg-decoding", None, None, None, "silent-misdirection", "refuse"),
)


class Support(NamedTuple):
    """One row of a support matrix; None matches anything."""

    requirement: str
    verdict: str
    media_type: str | None = None
    sample_depth: int | None = None
    colour_types: tuple = ()
    scan_mode: str | None = None
    colour_models: tuple = ()


SUPPORT_MATRIX = (
    Support("image-media-type", "true", "image/png"),
    Support("image-media-type", "true", "image/jpeg"),
    Support("image-media-type", "false", "image/webp"),
    Support("image-media-type", "false", "image/svg+xml"),
    Support("png-decoding", "true", None, 8, (0, 2, 3, 4, 6)),
    Support("png-decoding", "false", None, 16, (0, 2, 4, 6)),
    Support("jpeg-decoding", "true", None, None, (), "baseline", ("greyscale", "rgb")),
    Support("jpeg-decoding", "false", None, None, (), "progressive", ("rgb",)),
)
# Which images a requirement covers; all of them where it names no type.
APPLIES_TO = {"png-decoding": ("image/png",), "jpeg-decoding": ("image/jpeg",)}
IMAGE_REQUIREMENTS = ("image-media-type", "png-decoding", "jpeg-decoding")

# Activation -> (value, justification, judged on a device).
ACTIVATIONS = {
    "one_file_per_note": (True, "one-file-per-note-resolves", True),
    "footnote_backlinks": (False, "hardware-back-button", True),
    "strip_non_apparatus_hrefs": (True, "link-slots-are-per-screen", True),
}
PANEL = {"max_width_px": 480, "max_height_px": 800}

GLYPHS = ("U+21A9", "U+FE0E", "U+2510", "U+251C", "U+2518", "U+2E2E", "U+2192")

# name, evidence, consequence; the order is the order of every report.
OBSERVATIONS = (
    ("ordered-list-numbering-loss", "computable", "content-loss"),
    ("page-break-content-destruction", "computable", "content-loss"),
    ("unrenderable-images", "computable", "content-loss"),
    ("alt-text-fallback-absence", "computable", "content-loss"),
    ("colour-meaning-collapse", "flaggable", "content-loss"),
    ("strikethrough-inversion", "computable", "semantic-inversion"),
    ("table-relationship-loss", "computable", "semantic-inversion"),
    ("code-block-reflow", "computable", "structure-loss"),
    ("nested-list-flattening", "computable", "structure-loss"),
    ("caption-indistinction", "computable", "structure-loss"),
    ("alignment-meaning-flattening", "flaggable", "structure-loss"),
    ("boundary-chrome-presence", "flaggable", "contamination"),
    ("unrenderable-glyphs", "computable", "legibility"),
    ("diagram-text-legibility", "flaggable", "legibility"),
    ("footnote-target-reliability", "computable", "navigation"),
    ("link-footnote-dilution", "flaggable", "navigation"),
    ("pagination-granularity", "device-judged", "navigation"),
    ("ingress-conversion-acceptance", "device-judged", "content-loss"),
    ("library-title-presentation", "device-judged", "semantic-inversion"),
    ("library-author-presentation", "device-judged", "semantic-inversion"),
    ("library-cover-presentation", "device-judged", "content-loss"),
    ("navigation-usability", "device-judged", "navigation"),
    ("typography-preservation", "device-judged", "legibility"),
    ("colour-image-presentation", "device-judged", "content-loss"),
    ("footnote-usability", "device-judged", "navigation"),
    ("theme-adaptation", "device-judged", "legibility"),
    ("large-text-adaptation", "device-judged", "legibility"),
)
# What a small e-ink panel turns on.
ENABLED = (
    "footnote-target-reliability",
    "link-footnote-dilution",
    "page-break-content-destruction",
    "ordered-list-numbering-loss",
    "unrenderable-glyphs",
    "unrenderable-images",
    "alt-text-fallback-absence",
    "diagram-text-legibility",
    "colour-meaning-collapse",
    "strikethrough-inversion",
    "table-relationship-loss",
    "code-block-reflow",
    "boundary-chrome-presence",
)
