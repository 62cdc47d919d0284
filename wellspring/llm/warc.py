"""Web archives with a two-level capture index: compressed blocks of sorted lines, and a sparse directory of the blocks."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.files import Ranges, write_new
from wellspring.operators.keyed import attach_by_key
from wellspring.session import scratch_path, settle

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 * 1024 * 1024
BLOCK_LINES = 512
SHARD_ROWS = 100_000
MOST_SHARDS = 4096
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"  # the pages carry no time of capture
CAPTURE = "key string, record_id string, file string, at bigint, size bigint"
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?(.*)$", re.S)


def url_key(url: str | None) -> str:
    """The host's labels in reverse, then the rest: "http://www.a.org/x" gives "org,a,www)/x". Tabs and line ends are dropped."""
    url = re.sub(r"[\t\r\n]", "", url or "")
    match = _URL.match(url)
    if match is None:
        return url
    return ",".join(reversed(match[1].lower().split("."))) + ")" + (match[2] or "/")


def archive_record(record_id: str, url: str, kind: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record as one gzip member. The block of a response is its payload, that of a revisit is empty."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}",
            "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url), f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(payload)}")
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + squeeze.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, names in lower case, and block of a record."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {name.lower(): value for name, value in fields.items()}
    return fields, rest[:int(fields["content-length"])]


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, url, payload, digest and the id that the record refers to: null for responses.

    Of equal payloads of at least ``REVISIT_BYTES`` bytes the largest id is the response. Only digests are grouped, and
    only those found more than once are joined back.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"))
    rows = rows.withColumn("_digest", F.sha1("_payload"))
    digests = rows.where(F.octet_length("_payload") >= REVISIT_BYTES).select("_id", "_digest")
    groups = settle(digests.groupBy("_digest").agg(F.max("_id").alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    found = attach_by_key(rows, groups, ["_digest"], salt_by=["_id"])
    return found.select("_id", "_url", "_payload", "_digest", F.when(~F.col("_id").eqNullSafe(F.col("_best")), F.col("_best")).alias("_refers_to"))


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write the records and return their captures: key, record id, file, place and size."""
    rows = marked.select(F.col("_id").cast("string").alias("id"), "_url", "_payload", "_digest", F.col("_refers_to").cast("string").alias("to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, lines = [], 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, lines
            if held:
                name = write_new(folder, "pages.warc.gz", b"".join(held))
                columns = list(zip(*lines))
                yield pa.record_batch([pa.array(columns[0]), pa.array(columns[1], pa.string()), pa.array([name] * len(lines)),
                                       pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["key", "record_id", "file", "at", "size"])
            held, size, lines = [], 0, []

        for batch in batches:
            for page, url, payload, digest, to in zip(*[c.to_pylist() for c in batch.columns]):
                record = archive_record(str(page), url or "", "response" if to is None else "revisit", payload if to is None else b"", digest, to)
                lines.append((url_key(url), page, size, len(record)))
                held.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield from flush()
        yield from flush()

    return settle(rows.mapInArrow(write, CAPTURE))


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the captures, sorted by key over all shards, as compressed blocks; returns the sparse directory of the blocks.

    A directory row has the shard, the first and the last key of a block, and where the block is.
    """
    shards = min(MOST_SHARDS, max(1, -(-captures.count() // SHARD_ROWS)))
    ordered = captures.repartitionByRange(shards, "key", "record_id", "file", "at").sortWithinPartitions("key", "record_id", "file", "at")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, directory, size, lines = [], [], 0, []

        def close() -> None:
            nonlocal lines, size
            if lines:
                block = zlib.compress("\n".join("\t".join(map(str, line)) for line in lines).encode(), 6)
                directory.append((lines[0][0], lines[-1][0], size, len(block)))
                blocks.append(block)
                size, lines = size + len(block), []

        for batch in batches:
            for line in zip(*[c.to_pylist() for c in batch.columns]):
                lines.append([line[0], "" if line[1] is None else line[1], *line[2:]])
                if len(lines) >= BLOCK_LINES:
                    close()
        close()
        if blocks:
            name = write_new(folder, "index", b"".join(blocks))
            first, last, at, length = zip(*directory)
            yield pa.record_batch([pa.array([name] * len(first)), pa.array(first), pa.array(last), pa.array(at, pa.int64()), pa.array(length, pa.int64())],
                                  names=["shard", "first", "last", "at", "size"])

    return settle(ordered.mapInArrow(write, "shard string, first string, last string, at bigint, size bigint"))


def find_captures(urls: DataFrame, directory: DataFrame, folder: str, url_col: str = "url") -> DataFrame:
    """All captures of the given urls, each once: binary search in the directory, then one range read per block.

    The upper level, one row per shard (at most ``MOST_SHARDS``), says which shards can hold a key; a key that
    fills several shards is looked up in each. A shard's part of the directory goes to the tasks that search the
    shard, keys in order, so each block is read once.
    """
    shards = sorted((r["first"], r["last"], r["shard"]) for r in directory.groupBy("shard").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect())
    lasts = [s[1] for s in shards]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names = [], []
            for key in sorted({url_key(url) for url in batch.column(0).to_pylist()}):
                k = bisect.bisect_left(lasts, key)
                while k < len(shards) and shards[k][0] <= key:
                    keys.append(key)
                    names.append(shards[k][2])
                    k += 1
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(names, pa.string())], names=["key", "shard"])

    wanted = urls.select(F.col(url_col).cast("string").alias("_url")).mapInArrow(route, "key string, shard string").distinct()
    wanted = wanted.groupBy("shard").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # at most the keys of one shard
    blocks = directory.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("first", "last", "at", "size"))).alias("blocks"))
    jobs = wanted.join(blocks, "shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder)
        for batch in batches:
            for name, keys, blocks in zip(*[batch.column(c).to_pylist() for c in ("shard", "keys", "blocks")]):
                lasts, kept, found = [b["last"] for b in blocks], {}, []
                for key in keys:
                    k = bisect.bisect_left(lasts, key)
                    while k < len(blocks) and blocks[k]["first"] <= key:
                        if k not in kept:
                            text = zlib.decompress(ranges.read(name, blocks[k]["at"], blocks[k]["size"])).decode()
                            lines = [line.split("\t") for line in text.split("\n")]
                            kept = {k: ([line[0] for line in lines], lines)}
                        heads, lines = kept[k]
                        found += lines[bisect.bisect_left(heads, key):bisect.bisect_right(heads, key)]
                        k += 1
                columns = list(zip(*found)) or [()] * 5
                yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()),
                                       pa.array(list(map(int, columns[3])), pa.int64()), pa.array(list(map(int, columns[4])), pa.int64())],
                                      names=["key", "record_id", "file", "at", "size"])
        ranges.close()

    return jobs.select("shard", "keys", "blocks").mapInArrow(search, CAPTURE)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """Range reads of captures: id, type, payload bytes and digest as read, digest as declared, id referred to."""
    spread = captures.repartition(F.col("file")).sortWithinPartitions("file", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder)

        def page(text: str | None) -> str | None:
            value = text.removeprefix("<urn:page:").removesuffix(">") if text else None
            return None if value == "None" else value

        for batch in batches:
            out = []
            for name, at, size in zip(*[batch.column(c).to_pylist() for c in ("file", "at", "size")]):
                fields, payload = parse_record(ranges.read(name, at, size))
                out.append((page(fields["warc-record-id"]), fields["warc-type"], len(payload), hashlib.sha1(payload).hexdigest(),
                            fields["warc-payload-digest"].removeprefix("sha1:"), page(fields.get("warc-refers-to"))))
            columns = list(zip(*out)) or [()] * 6
            yield pa.record_batch([pa.array(c, pa.int64() if k == 2 else pa.string()) for k, c in enumerate(columns)],
                                  names=["id", "kind", "bytes", "sha1", "declared", "to"])
        ranges.close()

    return spread.mapInArrow(read, "id string, kind string, bytes bigint, sha1 string, declared string, to string")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of ``pages``, index the archives, look every url up and read its records back.

    One row per record: id, payload_bytes, payload_digest (both of the full payload, a revisit's from the response that it
    refers to), record_type and refers_to. A payload that differs from its declared digest stops the job.

    Null html is an empty payload, a null url is indexed under an empty key, a null id comes back as null. Rows
    that repeat the id of a response are responses too. An empty table gives an empty result; further columns are ignored.
    """
    folder, kind = scratch_path(pages.sparkSession, "warc"), pages.schema[id_col].dataType
    captures = write_archives(mark_revisits(pages, id_col, url_col, html_col), folder)
    directory = write_index(captures, folder)
    records = settle(read_records(find_captures(pages, directory, folder, url_col), folder))
    sound = (F.col("kind") == "revisit") | (F.col("sha1") == F.col("declared"))
    records = records.withColumn("declared", F.when(sound, F.col("declared")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))))
    known = settle(records.where("kind = 'response'").join(records.where("kind = 'revisit'").select("declared").distinct(), "declared", "left_semi")
                   .groupBy("declared").agg(F.max("bytes").alias("_full")))
    full = attach_by_key(records, known, ["declared"], salt_by=["id"])
    return full.select(F.col("id").cast(kind).alias(id_col), F.when(F.col("kind") == "revisit", F.col("_full")).otherwise(F.col("bytes")).alias("payload_bytes"),
                       F.col("declared").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("to").cast(kind).alias("refers_to"))
