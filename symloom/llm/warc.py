"""WARC records and a Merkle fixity audit of two replicas.

Records are dealt to archive files and numbered in order; a record's leaf is the hash of its file,
its offset range and its bytes, and every node above hashes the ordered, contiguous ranges of up to
``FAN`` children with their digests, up to one root for the whole replica. Equal roots settle the
audit. Otherwise only the children of branches that differ are compared, level by level, so what is
joined shrinks with the damage, not with the archive. Replicas are laid out on their own: a shorter or
missing record shifts all that follow in its file. Records of differing leaves are therefore aligned by
record id within their file, and those with equal bytes are no damage, wherever they stand.

Defined results: null urls and pages are empty; repeated rows are records of their own; an empty
replica has no root and every record of the other is then missing or extra; columns other than
``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm.common import materialize, table

FAN = 16
#: Records of one archive file, on average; levels of a file's tree, more where a file has more records.
PER_FILE, DEPTH = 2_048, 4
#: Equal records are dealt in units of so many.
UNIT = 256
DATE = "2024-01-01T00:00:00Z"


def _header(kind: str, ident: str, date: str, uri: str, size: str) -> list[str]:
    return [
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:", ident, f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: ", uri,
        "\r\nContent-Type: text/html\r\nContent-Length: ", size, "\r\n\r\n",
    ]


def record_bytes(page_id: int, url: str, html: str, date: str = DATE) -> bytes:
    """One response record, as ``record`` builds it in a plan."""
    h = hashlib.sha256(f"{page_id}:{url}".encode()).hexdigest()
    ident = "-".join([h[:8], h[8:12], h[12:16], h[16:20], h[20:32]])
    body = html.encode()
    return "".join(_header("response", ident, date, url, str(len(body)))).encode() + body + b"\r\n\r\n"


def ident() -> Column:
    """A page's record id."""
    h = F.sha2(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("None")), F.coalesce(F.col("url"), F.lit(""))), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def record(date: str = DATE) -> Column:
    """A page's response record as bytes."""
    url, html = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))
    parts = _header("response", "\0id", date, "\0uri", "\0size")
    value = {"\0id": ident(), "\0uri": url, "\0size": F.octet_length(html).cast("string")}
    return F.concat(*[value.get(p, F.lit(p)) for p in parts], html, F.lit("\r\n\r\n")).cast("binary")


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record of a file; a record that the file cuts off
    ends where the file does."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in lines if ": " in line)
        size = int(headers.get("Content-Length", 0))
        block = data[end + 4 : end + 4 + size]
        stop = min(len(data), end + 8 + size)
        yield at, stop - at, headers, block
        at = stop


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length, kind, uri, block) of all records of uncompressed WARC files; one file
    is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, at, n, h.get("WARC-Type"), h.get("WARC-Target-URI"), block) for at, n, h, block in parse(data)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "offset", "length", "kind", "uri", "block"]
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, offset long, length long, kind string, uri string, block binary")


def _laid_out(records: DataFrame, *by: str) -> DataFrame:
    """The records with ordinal and offset in their files, in the order of ``by``."""
    order = Window.partitionBy("file").orderBy(*by)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumns({
        "ordinal": (F.row_number().over(order) - 1).cast("long"),
        "offset": F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"),
    })


def archive(pages: DataFrame, per_file: int = PER_FILE, keep: bool = True, also: dict[str, Column] | None = None) -> DataFrame:
    """(page_id, id, file, ordinal, offset, length, sha[, record]): pages dealt to files by hash, in page
    order there. Rows of one page id and url are dealt by their bytes, equal rows in units, so no key
    makes a file large. Bytes are hashed where they are read, so without ``keep`` they are never
    shuffled; ``also`` names further hashes, of bytes made from ``record``, with
    lengths as ``length_`` and the name."""
    files = max(1, -(-pages.count() // per_file))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), record().alias("record"))
    hashes = {"sha": F.sha2("record", 256)} | {k: F.sha2(c, 256) for k, c in (also or {}).items()}
    sizes = {"length": F.octet_length("record").cast("long")} | {f"length_{k}": F.octet_length(c).cast("long") for k, c in (also or {}).items()}
    rows = rows.withColumns(hashes | sizes)
    held = [F.first("record").alias("record")] if keep else []
    units = rows.groupBy("page_id", "url", *sizes, *hashes).agg(F.count("*").alias("n"), *held)
    units = units.withColumn("unit", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / UNIT).cast("int"))))
    units = units.withColumn("file", F.pmod(F.xxhash64("page_id", "url", "sha", "unit"), F.lit(files))).repartition("file")
    alike = F.least(F.lit(UNIT), F.col("n") - F.col("unit") * UNIT).cast("int")
    rows = units.withColumn("copy", F.explode(F.sequence(F.lit(1), alike)))
    rows = _laid_out(rows, "page_id", "url", "length", "sha").withColumn("id", ident())
    return rows.select("page_id", "id", "file", "ordinal", "offset", *sizes, *hashes, *(["record"] if keep else []))


def leaves(records: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node, first, stop, digest, page_id, id, sha): a leaf for each record, numbered over all files."""
    text = F.concat_ws(":", F.lit("0"), "file", "offset", "length", "sha")
    place = F.col("file") * FAN**depth + F.col("ordinal")
    span = lambda at: F.struct(F.col("file").alias("file"), at.alias("offset"))
    return records.select(
        place.alias("node"), span(F.col("offset")).alias("first"), span(F.col("offset") + F.col("length")).alias("stop"),
        F.sha2(text.cast("binary"), 256).alias("digest"), "page_id", "id", "sha",
    )


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: each node hashes its ordered children (FAN at most) and their ranges."""
    child = F.struct("node", "first", "stop", "digest")
    up = nodes.groupBy("replica", F.floor(F.col("node") / FAN).alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"))
    said = F.transform("c", lambda x: F.concat_ws(":", x["node"], x["first"]["file"], x["first"]["offset"], x["stop"]["file"], x["stop"]["offset"], x["digest"]))
    return up.select(
        "replica", F.col("up").alias("node"), F.col("c")[0]["first"].alias("first"), F.element_at("c", -1)["stop"].alias("stop"),
        F.sha2(F.concat(F.lit("1|"), F.array_join(said, "|")).cast("binary"), 256).alias("digest"),
    )


def _differ(nodes: DataFrame, *kept: Column) -> DataFrame:
    """Nodes whose digests are not the same in both replicas."""
    of = lambda r: F.sort_array(F.collect_list(F.when(F.col("replica") == r, F.col("digest"))))
    return nodes.groupBy("node").agg(of("a").alias("a"), of("b").alias("b"), *kept).filter("a <> b")


def audit(a: DataFrame, b: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(page_id, file, ordinal, first_byte, stop_byte, status) of the records that differ between
    replicas (file, ordinal, offset, length, sha, page_id, id): 'changed', 'missing' in b, 'extra' in b.
    Ranges are replica a's where it has the record. A file with more than FAN ** depth records gets
    more levels, so that no two records share a node."""
    last = a.select("ordinal").union(b.select("ordinal")).agg(F.max("ordinal")).first()[0] or 0
    while last >= FAN**depth:
        depth += 1
    level = leaves(a, depth).withColumn("replica", F.lit("a")).unionByName(leaves(b, depth).withColumn("replica", F.lit("b")))
    levels = [materialize(level, "leaves")]
    while True:
        levels.append(materialize(parents(levels[-1]), "nodes"))
        if levels[-1].select("node").distinct().limit(2).count() <= 1:
            break
    bad = _differ(levels[-1])
    for nodes in reversed(levels[1:-1]):
        branch = nodes.join(bad.select(F.col("node").alias("up")), F.floor(nodes["node"] / FAN) == F.col("up"), "left_semi")
        bad = _differ(branch)
    nodes = levels[0]
    branch = nodes.join(bad.select(F.col("node").alias("up")), F.floor(nodes["node"] / FAN) == F.col("up"), "left_semi")
    branch = branch.join(_differ(branch).select("node"), "node", "left_semi").withColumn("file", F.col("first.file"))
    nth = lambda *by: F.row_number().over(Window.partitionBy("replica", "file", "id", *by).orderBy("node"))
    alike = Window.partitionBy("file", "id", "sha", "nth")
    alone = branch.withColumn("nth", nth("sha")).withColumn("both", F.count("*").over(alike)).filter("both = 1").withColumn("nth", nth())
    told = F.min(F.struct("replica", "first", "stop", "page_id", "node")).alias("told")
    found = alone.groupBy("file", "id", "nth").agg(told, F.count("*").alias("n"))
    status = F.when(F.col("n") == 2, "changed").when(F.col("told.replica") == "a", "missing").otherwise("extra")
    return found.select(
        F.col("told.page_id").alias("page_id"), "file", F.pmod(F.col("told.node"), F.lit(FAN**depth)).alias("ordinal"),
        F.col("told.first.offset").alias("first_byte"), F.col("told.stop.offset").alias("stop_byte"), status.alias("status"),
    )


def harmed(data: Column) -> Column:
    """Known damage, chosen by page id: one byte changed, or the end cut off."""
    at = F.crc32(F.col("page_id").cast("string"))
    flipped = F.concat(F.substring(data, 1, 64), F.lit(b"#"), F.substring(data, 66, 1 << 30))
    cut = F.substring(data, F.lit(1), F.octet_length(data) - 5)
    return F.when(at % 97 == 0, flipped).when(at % 89 == 1, cut).otherwise(data)


def present() -> Column:
    """Whether a replica with known damage has a record at all."""
    return F.coalesce(F.crc32(F.col("page_id").cast("string")) % 83 != 2, F.lit(True))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known damage, laid out on its own, of records that hold their bytes."""
    rows = records.filter(present()).withColumn("record", harmed(F.col("record")))
    return _laid_out(rows.withColumns({"sha": F.sha2("record", 256), "length": F.octet_length("record").cast("long")}), "ordinal")


def op4_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = materialize(archive(table(spark, sf_dir, "pages"), keep=False, also={"b": harmed(F.col("record"))}), "records")
    a = records.drop("b", "length_b")
    b = records.filter(present()).withColumns({"sha": F.col("b"), "length": F.col("length_b")}).drop("b", "length_b")
    return audit(a, _laid_out(b, "ordinal"))
