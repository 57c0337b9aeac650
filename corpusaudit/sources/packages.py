"""Packaged books -> members, package tables and content documents."""

import hashlib
import io
import xml.etree.ElementTree as ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.functions import refs as R
from corpusaudit.schema import MEMBERS, NODES, SEGMENTS
from corpusaudit.session import materialise
from corpusaudit.sources.archives import members_of
from corpusaudit.sources.html import read_element, segments_of
from corpusaudit.sources.rows import dealt, pruned, read_files

# Fixed values of the package format.
CONTAINER = "META-INF/container.xml"
CONTAINER_NS = "{urn:oasis:names:tc:opendocument:xmlns:container}"
OPF_NS = "{http://www.idpf.org/2007/opf}"
DC_NS = "{http://purl.org/dc/elements/1.1/}"
OPF_TYPE = "application/oebps-package+xml"
XHTML_TYPE = "application/xhtml+xml"
NCX_TYPE = "application/x-dtbncx+xml"


def _read_members(package_id, content, names=None):
    """(package_id, ord, name, byte_size, sha256, content, problem, current) of one archive, or of some names."""
    asked = None if names is None else frozenset(names)
    rows = []
    for place, name, size, _, current, data, problem in members_of(
        io.BytesIO(content or b""), lambda name: asked is None or name in asked
    ):
        digest = None if data is None else hashlib.sha256(data).hexdigest()
        rows.append((package_id, place, name, None if data is None else size, digest, data, problem, current))
    return rows


def packages_to_members(files: DataFrame, key: str = "package_id", content: str = "content", deal=True, columns=None) -> DataFrame:
    """Members of every archive in stored order; what cannot be read stays as a row.

    ``columns`` names the columns wanted, as contents weigh far more than all else. Archives are dealt out by their
    key first, unless they are already.
    """
    schema, keep = pruned(MEMBERS, columns)
    rows = lambda package_id, data: map(keep, _read_members(package_id, data))
    return read_files(dealt(files.select(key, content), key, deal=deal), rows, schema, (key, content))


def member_names(files: DataFrame, key: str = "package_id", content: str = "content") -> DataFrame:
    """(package_id, name) of current members, from the directories alone. What is no archive has an empty name."""

    def rows(package_id, data):
        stored = members_of(io.BytesIO(data or b""), lambda name: True, inflate=False)
        return [(package_id, name) for _, name, _, _, current, _, _ in stored if current]

    return read_files(files, rows, pruned(MEMBERS, ("package_id", "name"))[0], (key, content))


def named_members(files: DataFrame, wanted: DataFrame | tuple[str, ...], key: str = "package_id", content: str = "content") -> DataFrame:
    """Only the members that ``wanted`` names, a row for each stored; no other member is inflated.

    ``wanted`` is a tuple of names, or a table (package_id, name). What is no archive gives no row.
    """
    if isinstance(wanted, DataFrame):
        names = wanted.groupBy("package_id").agg(F.collect_set("name").alias("_names"))
        asked = files.select(F.col(key).alias("package_id"), F.col(content).alias("content")).join(names, "package_id")
    else:
        names = F.array(*map(F.lit, wanted))
        asked = files.select(F.col(key).alias("package_id"), F.col(content).alias("content"), names.alias("_names"))
    columns = ("package_id", "content", "_names")
    return read_files(asked, _read_members, MEMBERS, columns)


def current_members(members: DataFrame) -> DataFrame:
    """The member a name stands for: the last one stored under it, which the reader marked."""
    return members.filter("current")


_ROOTFILE = T.StructType(
    [
        T.StructField("package_id", T.LongType()),
        T.StructField("well_formed", T.BooleanType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("full_path", T.StringType()),
        T.StructField("media_type", T.StringType()),
    ]
)
_PACKAGE = T.StructType(
    [
        T.StructField("package_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("record", T.StringType()),  # package, item, itemref or meta
        T.StructField("ord", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("href", T.StringType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("properties", T.ArrayType(T.StringType())),
        T.StructField("linear", T.BooleanType()),
        T.StructField("value", T.StringType()),
    ]
)


def _parse(content):
    try:
        return ElementTree.fromstring(content or b"")
    except ElementTree.ParseError:
        return None


def _read_container(package_id, content):
    root = _parse(content)
    if root is None:
        return [(package_id, False, None, None, None)]
    files = [
        (package_id, True, i, e.get("full-path"), e.get("media-type"))
        for i, e in enumerate(root.iter(CONTAINER_NS + "rootfile"))
    ]
    return files or [(package_id, True, None, None, None)]


def _read_package(package_id, path, content):
    """One row for the package and one per manifest item, spine entry and cover entry."""
    root = _parse(content)
    head = (package_id, path)
    if root is None:
        return [(*head, "malformed", 0, None, None, None, None, None, None)]
    spine = root.find(OPF_NS + "spine")
    title = next((e.text or "" for e in root.iter(DC_NS + "title")), "").strip()
    toc = None if spine is None else spine.get("toc")
    rows = [(*head, "package", 0, toc, None, root.get("version"), None, None, title or None)]
    for i, e in enumerate(root.iter(OPF_NS + "item")):
        words = (e.get("properties") or "").split()
        rows.append(
            (*head, "item", i, e.get("id"), e.get("href"), e.get("media-type") or "", words, None, None)
        )
    if spine is not None:
        for i, e in enumerate(spine.iter(OPF_NS + "itemref")):
            linear = e.get("linear") != "no"
            rows.append((*head, "itemref", i, e.get("idref"), None, None, None, linear, None))
    for i, e in enumerate(root.iter(OPF_NS + "meta")):
        if e.get("name") == "cover":
            rows.append((*head, "meta", i, e.get("content"), None, None, None, None, None))
    return rows


def package_paths(members: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(package_id, present, well_formed, path): the package document each container names.

    ``members`` are current members. The first root file of the package type wins, else the first.
    ``packages`` names all packages where ``members`` are only some.
    """
    packages = (members if packages is None else packages).select("package_id").distinct()
    containers = members.filter((F.col("name") == CONTAINER) & F.col("content").isNotNull())
    found = read_files(containers.select("package_id", "content"), _read_container, _ROOTFILE, ("package_id", "content"))
    member = R.join_path(F.lit(""), F.col("full_path"))
    typed = F.when(F.col("media_type") == OPF_TYPE, F.lit(0)).otherwise(F.lit(1))
    usable = F.when(member.isNotNull(), F.struct(typed.alias("t"), "ord"))
    chosen = found.groupBy("package_id").agg(
        F.bool_and("well_formed").alias("well_formed"), F.min_by(member, usable).alias("path")
    )
    return packages.join(chosen, "package_id", "left").select(
        "package_id",
        F.col("well_formed").isNotNull().alias("present"),
        F.coalesce("well_formed", F.lit(False)).alias("well_formed"),
        "path",
    )


def members_to_package(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, records) of packages: ``package_paths`` and the rows of their package documents.

    Item rows gain ``target``, the member they name (NULL outside the archive), and ``reference``,
    the class of their link. Both tables are small beside the members and are kept.
    """
    paths = materialise(package_paths(members))
    wanted = paths.filter(F.col("path").isNotNull()).select("package_id", F.col("path").alias("name"))
    return paths, materialise(_records(members.join(wanted, ["package_id", "name"])))


def open_packages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, records) as ``members_to_package`` gives them, of archives (package_id, content).

    Reads the directory of each archive and inflates its container, then the package document named there.
    Unlike there a file that is no archive is a package without a container.
    """
    containers = current_members(named_members(files, (CONTAINER,)))
    paths = materialise(package_paths(containers, files))
    wanted = paths.filter(F.col("path").isNotNull()).select("package_id", F.col("path").alias("name"))
    return paths, materialise(_records(current_members(named_members(files, wanted))))


def _records(documents: DataFrame) -> DataFrame:
    """What package documents (package_id, name, content) say, with references resolved."""
    held = documents.filter(F.col("content").isNotNull()).select("package_id", F.col("name").alias("path"), "content")
    records = read_files(held, _read_package, _PACKAGE, ("package_id", "path", "content"))
    ref = R.classify_reference(F.col("path"), F.col("href"))
    return records.withColumn("_ref", F.when(F.col("href").isNotNull(), ref)).select(
        *records.columns, F.col("_ref.kind").alias("reference"), F.col("_ref.target").alias("target")
    )


def manifest(records: DataFrame) -> DataFrame:
    """Items that have both an id and an href, by id and stored order."""
    return records.filter(
        (F.col("record") == "item") & F.col("id").isNotNull() & F.col("href").isNotNull()
    )


def spine(records: DataFrame) -> DataFrame:
    return records.filter((F.col("record") == "itemref") & F.col("id").isNotNull())


DOCUMENT_NODES = T.StructType(
    [
        T.StructField("package_id", T.LongType(), False),
        T.StructField("document", T.StringType(), False),
        T.StructField("well_formed", T.BooleanType(), False),
        *NODES.fields,
    ]
)
DOCUMENT_SEGMENTS = T.StructType(
    [
        T.StructField("package_id", T.LongType(), False),
        T.StructField("document", T.StringType(), False),
        *SEGMENTS.fields,
    ]
)


def _document_nodes(package_id, document, content):
    """Nodes of one content document; a malformed one is a single row that says so."""
    head = (package_id, document)
    root = _parse(content)
    if root is None:
        lost = [package_id, 0, 0, None, 0, 0, "html", "", "#malformed", *[None] * 11, False, False, None, None, None, False]
        return [(*head, False, *lost)]
    return [(*head, True, *row) for row in read_element(package_id, root)]


def _document_segments(package_id, document, content):
    root = _parse(content)
    if root is None:
        return []
    return [(package_id, document, *row) for row in segments_of(package_id, read_element(package_id, root))]


def document_names(records: DataFrame, types=(XHTML_TYPE,)) -> DataFrame:
    """(package_id, name) of every manifest item of a document type, once."""
    return (
        manifest(records)
        .filter(F.col("media_type").isin(*types) & F.col("target").isNotNull())
        .select("package_id", F.col("target").alias("name"))
        .distinct()
    )


def content_documents(members: DataFrame, records: DataFrame, types=(XHTML_TYPE,)) -> DataFrame:
    """(package_id, document, content) of every manifest item of a document type, once."""
    return (
        members.join(document_names(records, types), ["package_id", "name"])
        .filter(F.col("content").isNotNull())
        .select("package_id", F.col("name").alias("document"), "content")
    )


def documents_to_nodes(documents: DataFrame) -> DataFrame:
    """Nodes of content documents, with package, document and whether it is well-formed."""
    columns = ("package_id", "document", "content")
    return read_files(documents.select(*columns), _document_nodes, DOCUMENT_NODES, columns)


#: Kind of the rows of ``archived_nodes`` that are blocks of visible text: ``node`` is the number of a block.
SEGMENT = "#segment"


def _segment_row(package_id, document, number, text):
    return (package_id, document, True, package_id, number, number, None, 0, 0, "html", "", SEGMENT, *[None] * 11, False, False, None, text, None, True)


def archived_nodes(
    files: DataFrame, records: DataFrame, kinds, columns, named=False, text=False, types=(XHTML_TYPE,)
) -> DataFrame:
    """Nodes of the content documents of archives (package_id, content), of the named kinds and columns.

    What ``documents_to_nodes`` gives for ``content_documents``, but no content is written, joined or shuffled:
    members are read while their archive is at hand, and of what that gives the manifest's documents stay. ``named``
    adds nodes of any kind with an identifier, ``text`` the visible text as ``SEGMENT`` rows. Documents that are not
    well-formed always have their row.
    """
    wanted = frozenset(kinds)
    schema, keep = pruned(DOCUMENT_NODES, columns)

    def rows(package_id, data):
        for _, document, _, _, current, content, _ in members_of(io.BytesIO(data or b""), lambda name: True):
            if not current or content is None:
                continue
            root = _parse(content)
            if root is None:
                yield from map(keep, _document_nodes(package_id, document, None))
                continue
            read = read_element(package_id, root, words=text)
            for row in read:
                if row[8] in wanted or (named and row[11] is not None):
                    yield keep((package_id, document, True, *row))
            for _, number, said in segments_of(package_id, read) if text else ():
                yield keep(_segment_row(package_id, document, number, said))

    read = read_files(files.select("package_id", "content"), rows, schema, ("package_id", "content"))
    declared = document_names(records, types).withColumnRenamed("name", "document")
    return read.join(declared, ["package_id", "document"], "left_semi")


def archived_segments(nodes: DataFrame) -> DataFrame:
    """(package_id, document, seq, text) as ``documents_to_segments`` gives them, of ``archived_nodes`` with ``text``."""
    return nodes.filter(F.col("kind") == SEGMENT).select("package_id", "document", F.col("node").alias("seq"), "text")


def documents_to_segments(documents: DataFrame) -> DataFrame:
    """Visible text of well-formed content documents, one row per block."""
    columns = ("package_id", "document", "content")
    return read_files(documents.select(*columns), _document_segments, DOCUMENT_SEGMENTS, columns)
