"""WARC archives: writing with payload deduplication, reading by boundary chains.

Writing: one record per page.  Of pages with equal payloads of at least
``REVISIT_BYTES`` bytes the one with the largest page_id is a ``response``, the
others ``revisit`` it and carry no body.  Records go through Spark's own text
writer (a record ends in a line feed, which is the line separator), so any store
Spark can write to will do.

Reading: archives are cut at the record magic by Spark's splittable text reader,
so a file may be of any size and several tasks share it.  Every cut is a
candidate, also those inside payloads.  A task emits, per candidate, its offset
and the offset of its successor by the declared lengths.  Offsets inside a split
become file offsets by prefix sums over splits.  Per file, pointer jumping
(doubling) from offset 0 marks what is reachable; magic inside a payload is not.
A reachable record whose payload was cut is put together again from its pieces.

Defined results: a null html is an empty payload, a null url an empty target; a
null page_id stays null; carriage returns and line feeds in urls are percent
encoded; repeated rows are records each (equal page_ids are one group member, so
all of them are responses if theirs is the largest); an empty table writes no
record and reads back empty; bytes after the last reachable record are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import joined, stored

MAGIC = "WARC/1.0\r\n"
REVISIT_BYTES = 1000
BROADCAST_REVISITS = 100_000
STRETCH = 1 << 20
EOL = "\r\n"


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes and refers_to (null: a response)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("payload_bytes"))
    groups = (
        p.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keeper"))
        .where("n > 1")
        .drop("n")
    )
    # Only members of repeated payloads meet the groups, without their payloads.
    members = joined(p.select("page_id", "digest", "payload_bytes").where(F.col("payload_bytes") >= REVISIT_BYTES), groups, ["digest"])
    # Payloads stay where they are while the revisits, counted first, are few; else they are joined by shuffle.
    refers = members.where(~F.col("page_id").eqNullSafe(F.col("keeper"))).groupBy(F.col("page_id").alias("__page"), F.col("digest").alias("__digest")).agg(F.max("keeper").alias("refers_to"))
    refers = stored(refers, "revisits")
    if refers.count() <= BROADCAST_REVISITS:
        refers = F.broadcast(refers)
    on = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest"))
    return p.join(refers, on, "left").drop("__page", "__digest")


def record_text(date: str = "2020-01-01T00:00:00Z") -> Column:
    """A whole record but for its last line feed, which the writer adds."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL + EOL))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = [
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"{EOL}WARC-Record-ID: "), _urn(F.col("page_id")),
        F.lit(f"{EOL}WARC-Date: {date}{EOL}WARC-Target-URI: "), url, F.lit(f"{EOL}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{EOL}WARC-Refers-To: "), _urn(F.col("refers_to")))).otherwise(""),
        F.lit(f"{EOL}Content-Type: application/http; msgtype=response{EOL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL),
    ]
    return F.concat(*head, block, F.lit("\r\n\r"))


def write(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", records_per_file: int = 50_000) -> None:
    """One record per page into the WARC files of a new folder."""
    plan_records(pages).select(record_text(date).alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


_FIELD = re.compile(rb"(?im)^(WARC-Type|WARC-Record-ID|WARC-Target-URI|WARC-Payload-Digest|WARC-Refers-To|Content-Length):[ \t]*([^\r\n]*)")
_PAGE = re.compile(rb"<urn:page:(-?\d+)>")
_OUT = "path string, block long, local long, size long, next long, head long, body long, type string, page_id long, url string, refers_to long, said string, digest string, payload_bytes long, payload string"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
_SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in _OUT.split(", "))])


def _page(v: bytes | None) -> int | None:
    m = _PAGE.match(v or b"")
    return int(m[1]) if m else None


def parse(chunk: bytes, keep: bool) -> dict | None:
    """What the bytes after a magic say, if they begin with a record's header.

    ``digest`` is null when the payload goes on after the chunk.
    """
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    f = {k.lower(): v for k, v in _FIELD.findall(chunk[: end + 2])}
    try:
        body = int(f[b"content-length"])
    except (KeyError, ValueError):
        return None
    if body < 0 or b"warc-type" not in f:
        return None
    head = end + 4
    out = {
        "head": head, "body": body, "type": f[b"warc-type"].decode("utf-8", "replace"), "page_id": _page(f.get(b"warc-record-id")),
        "url": f.get(b"warc-target-uri", b"").decode("utf-8", "replace"), "refers_to": _page(f.get(b"warc-refers-to")),
        "said": f.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:"),
    }
    if head + body <= len(chunk):
        out |= payload(chunk[head : head + body], out["type"], out["said"], keep)
    return out


def payload(block: bytes, kind: str, said: str, keep: bool) -> dict:
    """Digest and length of an HTTP block's payload; a revisit has those of the payload it stands for."""
    cut = block.find(b"\r\n\r\n")
    data = block[cut + 4 :] if cut >= 0 else block
    if kind == "revisit":
        m = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", block[: max(cut, 0) + 2])
        return {"digest": said, "payload_bytes": int(m[1]) if m else None, "payload": None}
    return {"digest": hashlib.sha1(data).hexdigest(), "payload_bytes": len(data), "payload": data.decode("utf-8", "replace") if keep else None}


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archive cut at every magic: value, path and the split's first byte, in file order within a split."""
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def candidates(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per cut; ``local`` is its place in the split, ``next`` its distance to the successor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = 0, None
        for b in batches:
            rows = []
            for value, name, block in zip(b.column("value").cast(pa.binary()).to_pylist(), b.column("path").to_pylist(), b.column("block").to_pylist(), strict=True):
                if (name, block) != seen:
                    at, seen = 0, (name, block)
                row = {"path": name, "block": block, "local": at, "size": len(value)}
                if (p := parse(value, keep_payload)) is not None:
                    row |= p | {"next": len(MAGIC) + p["head"] + p["body"] + 4}
                rows.append(row)
                at += len(value) + len(MAGIC)
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return chunks(spark, path).mapInArrow(run, _OUT)


def reach(offsets: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of the sorted offsets lie on the chain from offset 0, by pointer doubling."""
    n = len(offsets)
    at = np.searchsorted(offsets, following)
    at = np.where((at < n) & (offsets[np.minimum(at, n - 1)] == following), at, n)
    jump = np.append(at, n)  # n: off the chain, and stays there
    on = np.append(offsets == 0, False)
    for _ in range(max(1, int(n).bit_length())):
        on[jump[on]] = True
        on[n] = False
        jump = jump[jump]
    return on[:n]


def _chain(t: pa.Table) -> pa.Table:
    t = t.sort_by("off")
    return t.select(["path", "off"]).filter(pa.array(reach(t["off"].to_numpy(), t["following"].to_numpy())))


def records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """The records of all WARC files below ``path``, verified by their boundary chains."""
    cand = stored(candidates(spark, path, keep_payload), "candidates")
    splits = cand.groupBy("path", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("len"))
    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("path", "block", F.coalesce(F.sum("len").over(w), F.lit(0)).alias("base"))
    off = F.col("base") + F.col("local") - len(MAGIC)
    placed = cand.join(bases, ["path", "block"]).withColumn("off", off).where("off >= 0 and next is not null")
    on = placed.select("path", "off", (F.col("off") + F.col("next")).alias("following")).groupBy("path").applyInArrow(_chain, "path string, off long")
    found = placed.join(on, ["path", "off"], "left_semi")
    wanted = ["path", "off", "type", "page_id", "url", "refers_to", "digest", "payload_bytes", *["payload"] * keep_payload]
    whole = found.where("digest is not null").select(*wanted)
    cut = found.where("digest is null").select("path", "off", "head", "body", "type", "page_id", "url", "refers_to", "said")
    if cut.isEmpty():
        return whole
    return whole.unionByName(_rejoin(spark, path, bases, cut, keep_payload).select(*wanted))


def _rejoin(spark: SparkSession, path: str, bases: DataFrame, cut: DataFrame, keep: bool) -> DataFrame:
    """Reads cut records again and joins their pieces (all within one record's bytes)."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = 0, None
        for b in batches:
            local = []
            size = [len(v) for v in b.column("value").cast(pa.binary()).to_pylist()]
            for n, *key in zip(size, b.column("path").to_pylist(), b.column("block").to_pylist(), strict=True):
                if key != seen:
                    at, seen = 0, key
                local.append(at)
                at += n + len(MAGIC)
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("block"), pa.array(local, pa.int64()), b.column("value")], ["path", "block", "local", "value"])

    pieces = chunks(spark, path).mapInArrow(placed, "path string, block long, local long, value string")
    pieces = pieces.join(bases, ["path", "block"]).select("path", (F.col("base") + F.col("local") - len(MAGIC)).alias("at"), "value")
    # Records meet their pieces by file and stretch of ``STRETCH`` bytes, so a long file is dealt over many tasks.
    stretch = lambda c: F.floor(c / STRETCH)
    pieces = pieces.withColumn("stretch", stretch(F.col("at")))
    cut = cut.withColumn("stretch", F.explode(F.sequence(stretch(F.col("off")), stretch(F.col("off") + len(MAGIC) + F.col("head") + F.col("body")))))
    near = pieces.join(cut, ["path", "stretch"]).where(F.col("at") < F.col("off") + len(MAGIC) + F.col("head") + F.col("body")).where("at >= off")

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        r = {k: t[k][0].as_py() for k in ("path", "off", "type", "page_id", "url", "refers_to", "said", "head", "body")}
        data = MAGIC.encode().join(t["value"].cast(pa.binary()).to_pylist())
        row = r | payload(data[r["head"] : r["head"] + r["body"]], r["type"], r["said"], keep)
        return pa.Table.from_pylist([{k: row[k] for k in made.names}], made)

    made = pa.schema([*[(k, _SCHEMA.field(k).type) for k in ("path", "type", "page_id", "url", "refers_to", "digest", "payload_bytes", "payload")], ("off", pa.int64())])
    return near.groupBy("path", "off").applyInArrow(join, "path string, type string, page_id long, url string, refers_to long, digest string, payload_bytes long, payload string, off long")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
r as (select *, max(page_id) over (partition by payload_digest) as keeper from q)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> keeper then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> keeper then keeper end as refers_to
from r
"""
