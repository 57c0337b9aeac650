"""Schemas of the shared tables. Nothing is inferred."""

from pyspark.sql import types as T

NODES = T.StructType(
    [
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("node", T.IntegerType(), False),  # position in reading order
        T.StructField("end_node", T.IntegerType(), False),  # last position inside
        T.StructField("parent", T.IntegerType()),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("sib", T.IntegerType(), False),  # position among the parent's children
        T.StructField("root", T.StringType(), False),  # meta, blocks or html
        T.StructField("pointer", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("tag", T.StringType()),  # source tag, or format of raw markup
        T.StructField("level", T.IntegerType()),
        T.StructField("ident", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("href", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("list_start", T.IntegerType()),
        T.StructField("list_style", T.StringType()),
        T.StructField("read_block", T.IntegerType()),  # innermost reading block
        T.StructField("text_seg", T.IntegerType()),  # segment of visible text
        T.StructField("measured", T.BooleanType(), False),
        T.StructField("in_image", T.BooleanType(), False),
        T.StructField("label", T.StringType()),  # text inside a link, image or heading
        T.StructField("text", T.StringType()),  # own text of a leaf
        T.StructField("note", T.IntegerType()),  # innermost note around it
        T.StructField("closed", T.BooleanType(), False),  # whether its end was written out
    ]
)

SEGMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
    ]
)

MEMBERS = T.StructType(
    [
        T.StructField("package_id", T.LongType(), False),
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("byte_size", T.LongType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("problem", T.StringType()),
        T.StructField("current", T.BooleanType(), False),  # the last one stored under its name
    ]
)

IMAGE = T.StructType(
    [
        T.StructField("media_type", T.StringType()),
        T.StructField("intact", T.BooleanType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("sample_depth", T.IntegerType()),
        T.StructField("colour_type", T.IntegerType()),
        T.StructField("scan_mode", T.StringType()),
        T.StructField("colour_model", T.StringType()),
        T.StructField("alpha", T.BooleanType()),
    ]
)

VERDICTS = ("true", "false", "unknown", "unevaluable", "not_applicable")
