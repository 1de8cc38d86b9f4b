"""WARC archives: writing with revisit records, and reading by boundary-chain verification (operator 11).

Writing.  A record per page; of equal payloads the one with the greatest key is a response, the others are revisits that
hold the same HTTP header and refer to it.  Payloads that occur once never leave their task: a filter of bounded size tells
which may occur again, and only those are dealt out.

Reading.  Archives are read in splits, cut at every ``WARC/1.1`` line, also where it stands inside a payload:

1. Each task emits its candidates, headers that parse, with the offset of the record that must follow; it
   follows these links as far as they stay in its split.
2. Pointer jumping over the links that leave a split, from the start of each file, finds where the chain of records enters
   each split; doubling makes that a few rounds for any number of splits.
3. From there the chain is walked in each split, and just the records on it are kept.  A chain must end at the end of
   its file.  Payloads with such lines inside are put together again from the pieces.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sharetide.llm.common import op_query, table
from sharetide.llm.groups import with_group
from sharetide.llm.seeds import member_filter
from sharetide.session import fresh_path, stage

MAGIC = b"WARC/1.1\r\n"
GAP = b"\r\n\r\n"  # ends headers and records
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUCKET = 16  # bits of offset: pieces of records are looked up by stretches of 64 KB


def digest_of(payload: Column) -> Column:
    """SHA-1 of a text's UTF-8 bytes in upper-case base32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _name(key: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(key.cast("string")), F.lit("null")), F.lit(":"), digest, F.lit(">"))


def _record(date: str) -> Column:
    """A record without the gap at its end, from key, url, payload, bytes, digest, response, lead."""
    crlf = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    size = F.octet_length(http) + F.when(F.col("response"), F.col("bytes")).otherwise(0)
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    # A line break, or the magic at the end of the address, would read as the end of a field or a record.
    url = F.regexp_replace(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), r"W(ARC/1\.1)$", "%57$1")
    return F.concat(
        F.concat_ws(
            "\r\n",
            F.lit("WARC/1.1"),
            F.when(F.col("response"), "WARC-Type: response").otherwise("WARC-Type: revisit"),
            field("WARC-Record-ID", _name(F.col("key"), F.col("digest"))),
            F.lit(f"WARC-Date: {date}"),
            field("Content-Length", size.cast("string")),
            F.lit("Content-Type: application/http; msgtype=response"),
            field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(~F.col("response"), field("WARC-Refers-To", _name(F.col("lead"), F.col("digest")))),
            F.when(~F.col("response"), f"WARC-Profile: {PROFILE}"),
            field("WARC-Target-URI", url),
        ),
        crlf, crlf, http, F.when(F.col("response"), F.col("payload")).otherwise(""),
    )


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", column: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z"
) -> None:
    """Write a record per row of ``pages`` to WARC files in the new folder ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the greatest key is a response and the others
    revisit it; of rows that tie in the key one is picked.  All smaller ones are responses.  A null payload is empty; a null
    key is the least and is written as ``null``; a null address has no field.  An empty table gives no records.  Other columns
    are left behind.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", digest_of(F.col("payload")))
    rows = rows.withColumn("route", F.xxhash64("digest", "bytes"))
    eligible = F.col("bytes") >= min_bytes
    seeds = stage(rows.where(eligible).groupBy(F.col("route").alias("seed")).agg(F.count("*").alias("n")).where("n > 1"), "payloads")
    test = member_filter(seeds)

    @F.pandas_udf("boolean")
    def repeated(route: pd.Series) -> pd.Series:
        return pd.Series(test(route.to_numpy().view(np.uint64)))

    known = rows.withColumn("again", eligible & repeated("route"))
    alone = known.where(~F.col("again")).withColumn("response", F.lit(True)).withColumn("lead", F.col("key"))
    met = stage(known.where("again").withColumn("uid", F.monotonically_increasing_id()), "repeated")
    led = with_group(met, ["digest", "bytes"], F.col("uid"), lead=(F.max(F.struct("key", "uid")), F.max))
    decided = led.withColumn("response", F.col("uid") == F.col("lead")["uid"]).withColumn("lead", F.col("lead")["key"])
    used = ("key", "url", "payload", "bytes", "digest", "response", "lead")
    alone.select(*used).unionByName(decided.select(*used)).select(_record(date).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def fields_of(head: bytes) -> dict[bytes, bytes] | None:
    """Header fields by lower-case name; None if a line isn't a field."""
    out, last = {}, None
    for line in head.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last:
            out[last] += b" " + line.strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def parse(chunk: bytes) -> tuple[int, int, dict[bytes, bytes]] | None:
    """Size of the header with its gap, size of the block, and fields of what follows a magic; None if it's no header."""
    end = chunk.find(GAP)
    if end < 0:
        return None
    fields = fields_of(chunk[:end])
    if not fields or not fields.get(b"content-length", b"").isdigit() or not {b"warc-type", b"warc-record-id", b"warc-date"} <= fields.keys():
        return None
    return end + len(GAP), int(fields[b"content-length"]), fields


def content(fields: dict[bytes, bytes], block: bytes) -> tuple[bytes | None, int, str]:
    """Payload (None for a revisit), size and digest of the full payload."""
    declared = fields.get(b"warc-payload-digest", b"").decode().rpartition(":")[2]
    head, payload = b"", block
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        head, _, payload = block.partition(GAP)
    if fields[b"warc-type"] == b"revisit":
        said = fields_of(head.partition(b"\r\n")[2]) or {}
        return None, int(said.get(b"content-length", b"0")), declared
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if declared and declared != found:
        raise ValueError(f"the payload of {fields[b'warc-record-id'].decode()} does not match its digest")
    return payload, len(payload), found


_RECORD = "record_type string, record_id string, refers_to string, url string, payload_bytes bigint, payload_digest string, payload binary"
_CHUNK = f"file bigint, file_size bigint, block bigint, at bigint, size bigint, hash bigint, next bigint, exit bigint, whole boolean, {_RECORD}"
_CHUNK_NAMES = [x.split()[0] for x in _CHUNK.split(", ")]


def _described(fields: dict[bytes, bytes]) -> tuple:
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    return text(b"warc-type"), text(b"warc-record-id"), text(b"warc-refers-to"), text(b"warc-target-uri")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("file", "file_size", "block", "at", "size", "hash", "next", "exit")]
    + [("whole", pa.bool_()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("url", pa.string())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def _exits(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """For each candidate of a split (in order), the first offset on its chain that is none of the split's candidates."""
    out = following.copy()
    while len(at):
        place = np.minimum(np.searchsorted(at, out), len(at) - 1)
        here = at[place] == out
        if not here.any():
            break
        out = np.where(here, out[place], out)
    return out


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """All that lies between two magics, in order of place within a split."""
    raw = spark.read.option("lineSep", MAGIC.decode()).text(path)
    meta = F.col("_metadata")
    value = F.col("value").cast("binary")
    return raw.select(F.xxhash64(meta["file_path"]).alias("file"), meta["file_size"].alias("file_size"), meta["file_block_start"].alias("block"), F.xxhash64(value).alias("hash"), value.alias("value"))


def _scanner(payloads: bool):
    """Candidates and other chunks of each split, with offsets that count from the split's first chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pos, heads, nexts, size_of = None, 0, [], [], 0
        nothing = (None,) * 7

        def links() -> Iterator[pa.RecordBatch]:
            at, following = np.array(heads, np.int64), np.array(nexts, np.int64)
            out = _exits(at, following)
            n = len(at)
            if n:
                fill = {"file": np.full(n, now[0]), "file_size": np.full(n, size_of), "block": np.full(n, now[1]), "at": at, "exit": out}
                yield pa.RecordBatch.from_arrays([pa.array(fill[f.name], f.type) if f.name in fill else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)

        for b in batches:
            rows = []
            for file, file_size, block, hashed, value in zip(*[b.column(c).to_pylist() for c in ("file", "file_size", "block", "hash", "value")]):
                if now != (file, block):
                    if rows:
                        yield _table(rows, _ARROW)
                        rows = []
                    yield from links()
                    now, pos, heads, nexts, size_of = (file, block), 0, [], [], file_size
                found = parse(value) if block or pos else None
                at = pos - len(MAGIC)
                if found is None:
                    rows.append((file, file_size, block, at, len(value), hashed, None, None, None, *nothing))
                else:
                    head, length, fields = found
                    following = pos + head + length + len(GAP)
                    whole = head + length + len(GAP) == len(value) and value.endswith(GAP)
                    payload, n, digest = content(fields, value[head : head + length]) if whole else (None, None, None)
                    rows.append((file, file_size, block, at, len(value), hashed, following, None, whole, *_described(fields), n, digest, payload if payloads else None))
                    heads.append(at)
                    nexts.append(following)
                pos += len(value) + len(MAGIC)
            if rows:
                yield _table(rows, _ARROW)
        if now is not None:
            yield from links()

    return run


def reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Offsets (file, at) on the chains that begin at ``starts``, by pointer jumping over ``links`` (file, at, exit).

    After k rounds all places within 2**k links of a start are known and every link spans 2**k; places that are no link's begin
    (ends of files among them) are included.
    """
    known, jump, n = stage(starts, "reached"), stage(links, "jumps"), -1
    while (now := known.count()) != n:
        n = now
        known = stage(known.union(known.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at"))).distinct(), "reached")
        further = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("beyond"))
        jump = stage(jump.join(further, ["file", "exit"]).select("file", "at", F.col("beyond").alias("exit")), "jumps")
    return known


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (file, block, at), those on the chain from ``entry``."""
    now, expected = None, None
    for b in batches:
        keep = []
        for file, block, at, following, entry in zip(*[b.column(c).to_pylist() for c in ("file", "block", "at", "next", "entry")]):
            if now != (file, block):
                now, expected = (file, block), entry
            on = following is not None and at == expected
            keep.append(on)
            if on:
                expected = following
        yield b.filter(pa.array(keep, pa.bool_()))


def read_archives(spark: SparkSession, path: str, payloads: bool = False, strict: bool = True) -> DataFrame:
    """Records of the uncompressed WARC files under ``path``: ``record_type``, ``record_id``, ``refers_to``, ``url``,
    ``payload_bytes`` and ``payload_digest`` (base32 SHA-1) of the full payload, and with ``payloads`` the ``payload``.

    The payload of a revisit is null; its size and digest are those that its headers name.  What stands inside a payload is never
    taken for a record.  A payload that differs from its digest is an error; so is a file whose records do not end at its
    end, unless ``strict`` is false: then the records before the fault are returned.  No files give no rows.
    """
    chunks = stage(_chunks(spark, path).mapInArrow(_scanner(payloads), _CHUNK), "chunks")
    cut = chunks.where("size is not null")
    splits = cut.groupBy("file", "block").agg(F.max(F.col("at") + F.col("size") + 2 * len(MAGIC)).alias("total"), F.max("file_size").alias("file_size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(splits.select("file", "file_size", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases")
    links = stage(
        chunks.where("exit is not null").select("file", "block", "at", "exit").join(bases.select("file", "block", "base"), ["file", "block"])
        .select("file", "block", F.col("at").alias("local"), (F.col("at") + F.col("base")).alias("at"), (F.col("exit") + F.col("base")).alias("exit")), "links"
    )
    files = bases.groupBy("file").agg(F.max("file_size").alias("file_size"))
    places = reached(links.select("file", "at", "exit"), files.select("file", F.lit(0).cast("bigint").alias("at")))
    if strict:
        broken = files.join(places, (files["file"] == places["file"]) & (files["file_size"] == places["at"]), "left_anti").select("file").limit(3).collect()
        if broken:
            names = spark.read.format("binaryFile").load(path).select("path").where(F.xxhash64("path").isin([r[0] for r in broken])).limit(3).collect() or broken
            raise ValueError(f"records do not end at the end of the file: {[r[0] for r in names]}")
    entries = links.join(places, ["file", "at"]).select("file", "block", F.col("local").alias("entry"))
    placed = cut.join(bases.select("file", "block", "base"), ["file", "block"]).join(entries, ["file", "block"])
    on_chain = placed.sortWithinPartitions("file", "block", "at").mapInArrow(_walk, f"{_CHUNK}, base bigint, entry bigint")
    kept = stage(on_chain, "records")
    names = [n for n in _CHUNK_NAMES[9:] if payloads or n != "payload"]
    done = kept.where("whole").select(*names)
    parted = kept.where("not whole")
    if parted.isEmpty():
        return done
    return done.unionByName(_assembled(spark, path, parted, cut.join(bases.select("file", "block", "base"), ["file", "block"])).select(*names))


def _assembled(spark: SparkSession, path: str, records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records that magics cut into several chunks, put together again.

    Chunks are known by the hash of their bytes, and only those of such records are read again.
    """
    spans = records.select("file", (F.col("at") + F.col("base")).alias("start"), (F.col("next") + F.col("base")).alias("stop"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.shiftright("start", BUCKET), F.shiftright("stop", BUCKET))))
    index = chunks.select("file", (F.col("at") + F.col("base")).alias("place"), "size", "hash").withColumn("bucket", F.shiftright("place", BUCKET))
    parts = stage(spans.join(index, ["file", "bucket"]).where("place >= start and place < stop").select("file", "start", "stop", "place", "size", "hash"), "parts")
    test = member_filter(parts.select(F.col("hash").alias("seed")).distinct())

    @F.pandas_udf("boolean")
    def needed(hashed: pd.Series) -> pd.Series:
        return pd.Series(test(hashed.to_numpy().view(np.uint64)))

    again = _chunks(spark, path).select("hash", "value").where(needed("hash"))
    texts = again.withColumn("size", F.octet_length("value").cast("bigint")).groupBy("hash", "size").agg(F.first("value").alias("value"))
    listed = parts.join(texts, ["hash", "size"]).groupBy("file", "start", "stop").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("pieces"))
    schema = pa.schema([_ARROW.field(n) for n in _CHUNK_NAMES[9:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for start, stop, pieces in zip(*[b.column(c).to_pylist() for c in ("start", "stop", "pieces")]):
                record = MAGIC.join(p["value"] for p in pieces)
                head, length, fields = parse(record)
                if len(record) + len(MAGIC) != stop - start or not record.endswith(GAP):
                    raise ValueError(f"the record {fields[b'warc-record-id'].decode()} is not followed by an empty line")
                payload, n, digest = content(fields, record[head : head + length])
                rows.append((*_described(fields), n, digest, payload))
            yield _table(rows, schema)

    return listed.mapInArrow(run, _RECORD)


def _key(name: str, kind: str) -> Column:
    text = F.regexp_extract(name, "<urn:page:([^:]*):", 1)
    return F.when(text != "null", F.url_decode(text).cast(kind))


def page_records(records: DataFrame, kind: str = "bigint") -> DataFrame:
    """``records`` that ``write_archives`` wrote, with the keys of the page and of the page referred to."""
    return records.withColumn("key", _key("record_id", kind)).withColumn("refers_to_key", F.when(F.col("record_type") == "revisit", _key("refers_to", kind)))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGIT = " || ".join(f"substr('{_BASE32}', CAST((v >> {35 - 5 * i}) & 31 AS INT) + 1, 1)" for i in range(8))
_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, strlen(html) AS payload_bytes, list_aggregate(list_transform(range(4), lambda i:
  list_transform([CAST('0x' || substr(sha1(html), CAST(10 * i + 1 AS INT), 10) AS UBIGINT)], lambda v: {_DIGIT})[1]), 'string_agg', '') AS payload_digest,
  row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS r, max(page_id) OVER (PARTITION BY html) AS lead FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN r > 1 THEN lead END AS refers_to FROM d"""


@op_query("op11_warc", _SQL)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = page_records(read_archives(spark, path))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))
