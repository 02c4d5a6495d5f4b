"""Content-addressed web archive.

Two tables: ``payloads`` holds each distinct payload once, under its SHA-256,
and ``records`` holds one exact WARC/1.1 header block per page with the
address of its payload.  Reading rebuilds every original record byte for byte by
joining the two, checks each payload against its address and its records'
digests, and takes what it reports from the rebuilt bytes.

Of records with equal payloads the one with the smallest page id is the
response; the others are revisits that refer to it (payloads below
``minimum`` bytes are stored alike, but all their records are responses).

All expressions are native.  A payload moves once: equal ones are dropped within
each task before, and the table is bucketed by address, so that the join brings
headers to the payloads.  Records of a payload that very many pages share are
spread over tasks (``join_by_size``).

Defined cases: a null payload counts as empty; a null url is an empty target; a
url with line ends is percent-encoded there and kept exactly in a field of its
own; null page ids come last, so they refer to the smallest id that isn't null, and
are responses where there is none; rows that repeat the smallest id are all
responses; payloads of any length are digested whole (a row holds 2 GB at most);
an empty table gives an empty archive; extra input columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import Scratch, join_by_size

#: Fixed value: the base32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
UNDATED = "1970-01-01T00:00:00Z"
"""The date of records whose table has none."""


def base32_of_hex(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits (a SHA-1), five digits to four letters."""
    letters = []
    for i in range(8):
        number = F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.url_encode(F.coalesce(page_id.cast("string"), F.lit(""))), F.lit(">"))


def write(pages: DataFrame, scratch: Scratch, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: Column | None = None, minimum: int = 0) -> tuple[DataFrame, DataFrame]:
    """Write the archive and return its (records, payloads) tables as read back; ``date`` is a WARC date, a text."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    source = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), (F.lit(UNDATED) if date is None else date).alias("date"), payload.alias("payload"))
    source = source.withColumn("address", F.sha2("payload", 256))
    described = source.select("page_id", "url", "date", "address", F.octet_length("payload").cast("bigint").alias("bytes"), base32_of_hex(F.sha1("payload")).alias("digest"))
    described = scratch.write(described, "described")
    firsts = described.groupBy("address").agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))
    payloads = _bucketed(source.select("address", "payload").dropDuplicates(["address"]), "address", scratch)
    joined = join_by_size(described, firsts, "address", size="pages", total=scratch.rows(described))
    response = F.col("page_id").eqNullSafe(F.col("first")) | (F.col("bytes") < minimum)
    broken = F.col("url").rlike("[\r\n]")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), _id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.when(broken, F.concat(F.lit("X-Target-URI-Base64: "), F.regexp_replace(F.base64(F.col("url").cast("binary")), "[\r\n]", ""))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(~response, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}{END}WARC-Refers-To: "), _id(F.col("first")))),
        F.concat(F.lit("Content-Length: "), F.when(response, F.col("bytes")).otherwise(0).cast("string")),
    ]
    header = F.concat(F.concat_ws(END, *lines), F.lit(END + END))
    records = scratch.write(joined.select("page_id", header.alias("header"), "address"), "records")
    return records, payloads


def _bucketed(rows: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """The rows, whose plan deals them by ``key``, as a table in as many buckets as a shuffle has partitions."""
    spark = scratch.spark
    name, buckets = f"warc_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, key).option("path", f"{scratch.root}/{name}").saveAsTable(name)
    return spark.table(name)


def field(name: str) -> Column:
    """A header field's value, empty if absent."""
    return F.regexp_extract("header", f"(?m)^{name}: ([^\\r\\n]*)\\r?$", 1)


def target() -> Column:
    """A record's exact url."""
    exact = field("X-Target-URI-Base64")
    return F.when(exact != "", F.decode(F.unbase64(exact), "UTF-8")).otherwise(field("WARC-Target-URI"))


def rebuilt(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """``page_id, address, header, record`` of the responses: header, payload and end, as the file holds them.

    The payloads stay where they lie: each has one response, whose header comes to it.
    """
    good = F.assert_true(F.sha2("payload", 256) == F.col("address"), F.lit("payload doesn't match its address"))
    held = payloads.where(F.coalesce(good.cast("string"), F.lit("")) == "")
    responses = records.where(field("WARC-Type") == "response")
    whole = F.concat(F.col("header").cast("binary"), "payload", F.lit((END + END).encode()))
    return responses.hint("shuffle_merge").join(held, "address").select("page_id", "address", "header", whole.alias("record"))


def read(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """What the rebuilt records say of each page.

    A response's block is cut out of its bytes by the header's own length; its
    digest must be the one that the header names.  Revisits take what the response
    of their payload says.
    """
    length = field("Content-Length").cast("int")
    block = F.substring(F.col("record"), F.octet_length("header") + 1, length)
    told = rebuilt(records, payloads).select("address", F.octet_length(block).cast("bigint").alias("payload_bytes"), base32_of_hex(F.sha1(block)).alias("payload_digest"), (F.octet_length("record") == F.octet_length("header") + length + 4).alias("whole"))
    told = told.groupBy("address").agg(F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest"), F.bool_and("whole").alias("whole"))
    pages = records.groupBy("address").agg(F.count("*").alias("pages"))
    told = told.join(pages, "address")
    refers = F.url_decode(F.regexp_extract(field("WARC-Refers-To"), "<urn:page:([^>]*)>", 1))
    parsed = records.select("page_id", "address", field("WARC-Type").alias("record_type"), F.when(refers != "", refers).cast(records.schema["page_id"].dataType).alias("refers_to"), F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("named"))
    joined = join_by_size(parsed, told, "address", size="pages", total=Scratch.rows(records), how="left")
    same = F.assert_true(F.col("named").eqNullSafe(F.col("payload_digest")) & F.col("whole"), F.lit("record and payload digests differ"))
    return joined.where(F.coalesce(same.cast("string"), F.lit("")) == "").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def originals(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """``page_id, record``: the bytes of each record in a WARC file; revisits carry no block."""
    rest = records.where(field("WARC-Type") != "response")
    end = F.lit((END + END).encode())
    return rebuilt(records, payloads).select("page_id", "record").unionByName(rest.select("page_id", F.concat(F.col("header").cast("binary"), end).alias("record")))


def archive(pages: DataFrame, *, minimum: int = 0) -> DataFrame:
    """Write every page to the archive and read the archive back."""
    records, payloads = write(pages, Scratch(pages.sparkSession, "warc"), minimum=minimum)
    return read(records, payloads)
