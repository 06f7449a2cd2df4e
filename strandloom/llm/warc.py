"""Builder of WARC derivatives: for each response a metadata record and a plain-text conversion record.

Both refer to the response's record, carry the headers of their source and digests of what they hold. Record ids
are made from what a record is about, so that a repeated run gives the same ones. Responses are read from WARC files, or made
from a table of pages.
"""

from __future__ import annotations

from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import materialize, ship

ship(__name__)

# Every pattern matches at each of its beginnings, if need be up to the end of the text: what is never closed costs one pass.
#: Comments, scripts, styles and titles, without which a page's text is read.
SKIPPED = "(?is)<(?:!--.*?(?:-->|\\z)|" + "|".join(f"{t}\\b[^>]*(?:>.*?(?:</{t}\\s*>|\\z)|\\z)" for t in ("script", "style", "title")) + ")"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|title|blockquote|pre)\b[^>]*(?:>|\z)"
#: A tag begins with a letter, a slash and a letter, or a mark of declarations; other angle brackets are text.
TAGS = r"<(?:/?[A-Za-z]|[!?])[^>]*(?:>|\z)"
TITLE = r"(?is)<title\b[^>]*(?:>(.*?)(?:</title|\z)|\z)"
LINKS = r"(?i)<a\b[^<>]*\bhref\s*="
REFERENCE = r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Names of character references: HTML 4's, and apos.
NAMES = {**name2codepoint, "apos": 39, "nbsp": 32}


CRLF = "\r\n"
#: Where a record begins, less the last figure of its version.
VERSION = "WARC/1."
WEB_CHARSETS = {c: "windows-1252" for c in ("iso-8859-1", "latin1", "us-ascii", "ascii")}


def _character(code: str) -> str:
    """SQL of the character of a code point; numbers that are no character become U+FFFD."""
    valid = f"({code} between 1 and 55295 or {code} between 57344 and 1114111)"
    return f"decode(unhex(lpad(hex(if({valid}, {code}, 65533L)), 8, '0')), 'UTF-32')"


def _decoded(m: str) -> str:
    """SQL of what the reference m stands for; unknown names stay as they are. The map is a constant, made once."""
    characters = "\x01".join(map(chr, NAMES.values())).replace("'", "\\'")
    names = f"map_from_arrays(split('{' '.join(NAMES)}', ' '), split('{characters}', '\x01'))"
    base16 = f"cast(conv(substring({m}, 4, length({m}) - 4), 16, 10) as bigint)"
    base10 = f"cast(substring({m}, 3, length({m}) - 3) as bigint)"
    return (
        f"case when substring({m}, 2, 1) != '#' then coalesce(element_at({names}, substring({m}, 2, length({m}) - 2)), {m})"
        f" when lower(substring({m}, 3, 1)) = 'x' then {_character(base16)} else {_character(base10)} end"
    )


def with_decoded(df: DataFrame, column: str) -> DataFrame:
    """df with the character references of a column decoded, once."""
    df = df.withColumn("__refs", F.regexp_extract_all(column, F.lit(REFERENCE), F.lit(0)))
    pieces = F.split(column, REFERENCE, -1)
    made = F.expr(f"concat(transform(__refs, m -> {_decoded('m')}), array(''))")
    joined = F.array_join(F.flatten(F.zip_with(pieces, made, lambda x, y: F.array(x, y))), "")
    return df.withColumn(column, F.when(F.size("__refs") > 0, joined).otherwise(F.col(column))).drop("__refs")


def with_plain_text(df: DataFrame, html: str, out: str) -> DataFrame:
    """Adds out, the text of a page: no scripts, styles, titles or comments, closed or not; block tags end lines; spaces are single, lines trimmed and not empty.

    A tag ends at the next >, in quotes too. Angle brackets that begin no tag stay.
    """
    text = F.regexp_replace(F.coalesce(html, F.lit("")), SKIPPED, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\n]+", " "), BREAKS, "\n")
    df = with_decoded(df.withColumn(out, F.regexp_replace(text, TAGS, "")), out)
    text = F.regexp_replace(F.regexp_replace(out, r" +", " "), r" ?\n[ \n]*", "\n")
    return df.withColumn(out, F.btrim(text, F.lit(" \n")))


def with_title(df: DataFrame, html: str, out: str) -> DataFrame:
    df = with_decoded(df.withColumn(out, F.regexp_extract(F.coalesce(html, F.lit("")), TITLE, 1)), out)
    return df.withColumn(out, F.btrim(F.regexp_replace(out, r"\s+", " ")))


def record_id(*parts: Column) -> Column:
    """A urn:uuid made from the md5 of parts."""
    h = F.md5(F.concat_ws("\n", *parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", status: str = "HTTP/1.1 200 OK") -> DataFrame:
    """Response records of pages(page_id, url, html), for crawls kept as tables: page_id, target_uri, date, record_id, http_headers, payload and payload_digest.

    Such a table has no headers: a status line, type and length are made. Null urls and pages are empty. Pages with equal id, url and payload
    get the same record id. Other columns are not used.
    """
    payload = F.coalesce("html", F.lit(""))
    uri = F.coalesce("url", F.lit(""))
    head = F.concat(F.lit(f"{status}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(
        "page_id",
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri, F.sha2(payload, 256)).alias("record_id"),
        head.alias("http_headers"),
        payload.alias("payload"),
        digest(payload).alias("payload_digest"),
    )


def _field(head: str, name: str) -> Column:
    """The first header of a name; null if there is none."""
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))


def _whole_records(file: pd.DataFrame) -> pd.DataFrame:
    """(id, record, nth) of a file's pieces that are not a record by themselves: the piece that begins their record, null for what is no part of one, and their place in it.

    A record takes as many pieces after its own as its stated length needs, whatever they look like; only then may the next begin.
    """
    file = file.sort_values(["start", "id"])
    out, owner, nth, missing, size = [], None, 0, 0, 0
    for piece, length, begins, needs in zip(file["id"].tolist(), file["length"].tolist(), file["begins"].tolist(), file["needs"].tolist(), strict=True):
        if missing > 0:
            if not nth:
                out.append((owner, owner, 0))
            nth += 1
            out.append((piece, owner, nth))
            missing -= length + size
        elif begins:
            # the separator that was cut away counts where a piece follows
            owner, nth, size, missing = piece, 0, len(VERSION), needs - length
        else:
            out.append((piece, None, 0))
    return pd.DataFrame(out, columns=["id", "record", "nth"]).astype({"record": "Int64"})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files of versions 1.0 and 1.1, plain or gzipped: record_type, record_id, refers_to, target_uri, date, content_type, payload_digest, head, block (bytes) and complete.

    Spark's text reader cuts files at the beginning of version lines, so that plain ones are read in parallel; pieces are stored once. Blocks end by the length
    that their headers state: what is cut within one, even a whole record that it quotes, is put together again, by the pieces' lengths alone, a file
    at a time. complete says whether a block has its stated length, as the last one of a torn file has not. Without a length, a block ends at the next version line.
    """
    raw = spark.read.text(path, lineSep=VERSION).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    pieces = materialize(raw.withColumn("id", F.monotonically_increasing_id()), "warc-pieces")
    head = F.substring_index("value", CRLF * 2, 1)
    pieces = pieces.withColumn("__size", _field(head, "Content-Length").try_cast("long"))
    needs = F.octet_length(head) + 4 + F.coalesce("__size", F.lit(0))
    # the first characters of a record are what remains of its version line
    begins = F.coalesce(F.col("value").rlike(r"^[01]\r\n") & head.rlike(r"(?im)^WARC-Type:"), F.lit(False))
    light = pieces.select("file", "start", "id", F.octet_length("value").cast("long").alias("length"), begins.alias("begins"), needs.cast("long").alias("needs"))
    odd = materialize(light.groupBy("file").applyInPandas(_whole_records, "id long, record long, nth int"), "warc-odd-pieces")
    plain = pieces.join(odd.select("id"), "id", "left_anti").select("value", "__size")
    part = F.struct("nth", "value").alias("part")
    joined = pieces.join(odd.filter("record is not null"), "id").groupBy("record").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max(F.when(F.col("nth") == 0, F.col("__size"))).alias("__size"))
    joined = joined.select(F.array_join("parts.value", VERSION).alias("value"), "__size")
    rows = plain.unionByName(joined).withColumn("head", F.expr(f"substring(substring_index(value, '{CRLF * 2}', 1), 4)"))
    begin = F.octet_length(F.substring_index("value", CRLF * 2, 1)) + 5
    body = F.col("value").cast("binary")
    # without a length: what lies before the empty lines that end a record
    rest = F.when(F.col("__size").isNotNull(), F.substring(body, begin, F.col("__size").cast("int"))).otherwise(F.substring(body, begin, F.octet_length(body) - begin - 3))
    names = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest"}
    out = rows.select(*[_field("head", f).alias(c) for c, f in names.items()], "head", rest.alias("block"), "__size").filter("record_type is not null")
    return out.withColumn("complete", F.coalesce(F.octet_length("block") == F.col("__size"), F.lit(False))).drop("__size")


@F.pandas_udf(StringType())
def _in_charset(held: pd.Series, charset: pd.Series) -> pd.Series:
    """Texts of bytes in charsets by their names; UTF-8 for names that are not known. Invalid bytes are replaced."""

    def one(data: bytes | None, name: str) -> str | None:
        if data is None:
            return None
        try:
            # web pages that say so mean the windows charset, which has letters where the other has controls
            return data.decode(WEB_CHARSETS.get(name, name), "replace")
        except (LookupError, ValueError):
            return data.decode("utf-8", "replace")

    return pd.Series([one(d, c) for d, c in zip(held, charset, strict=True)], dtype=object)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """HTTP responses of WARC files as responses() returns them, without page_id: their own headers, all lines, and digests are kept, and complete of read_records().

    payload is text: bytes are decoded by the charset that the headers name, those of ISO-8859-1 and ASCII as windows-1252, which web pages mean by it; else as UTF-8. Invalid bytes are replaced. A record
    without a payload digest gets the payload's sha256. Transfer and content encodings must have been undone, as crawls in archives have them.
    """
    rows = read_records(spark, path).filter("record_type = 'response' and lower(content_type) like 'application/http%'")
    rows = rows.withColumn("http_headers", F.substring_index(F.col("block").cast("string"), CRLF * 2, 1))
    rows = rows.withColumn("__bytes", F.expr("substring(block, octet_length(http_headers) + 5)"))
    charset = F.lower(F.regexp_extract("http_headers", r"(?im)^content-type:[^\r\n]*charset=[\"']?([A-Za-z0-9_.:-]+)", 1))
    rows = rows.withColumn("__charset", charset)
    utf8 = F.col("__charset").isin("", "utf-8", "utf8")
    payload = F.when(utf8, F.make_valid_utf8(F.col("__bytes").cast("string"))).otherwise(_in_charset(F.when(~utf8, F.col("__bytes")), "__charset"))
    found = F.coalesce("payload_digest", F.concat(F.lit("sha256:"), F.sha2("__bytes", 256)))
    return rows.select(F.coalesce("target_uri", F.lit("")).alias("target_uri"), "date", "record_id", F.make_valid_utf8("http_headers").alias("http_headers"), payload.alias("payload"), found.alias("payload_digest"), "complete")


def derivatives(source: DataFrame) -> DataFrame:
    """Two records for each response of responses() or read_responses(): record_type metadata, then conversion.

    metadata holds warc-fields: the page's title, its number of links, the source's headers and its payload's digest. conversion holds the page's
    text. Each has its record_id, refers_to (the response's id), target_uri, date, content_type, content_length (bytes),
    block_digest, source_digest (of the response's payload), source_headers and block, and page_id if source has it. Null payloads and headers are empty.
    Repeated responses give repeated records, empty payloads empty texts. Time grows with the length of a page, whatever it leaves open.
    Other columns of source are not used.
    """
    keys = [c for c in ("page_id",) if c in source.columns]
    base = source.select(*keys, "target_uri", "date", "record_id", F.coalesce("http_headers", F.lit("")).alias("http_headers"), F.coalesce("payload", F.lit("")).alias("payload"), F.col("payload_digest").alias("source_digest"))
    base = with_title(with_plain_text(base, "payload", "text"), "payload", "title")
    base = base.withColumn("n_links", F.regexp_count("payload", F.lit(LINKS)))
    fields = F.concat(
        F.lit("title: "), F.col("title"), F.lit("\r\nlinks: "), F.col("n_links").cast("string"),
        F.lit("\r\nsource-payload-digest: "), F.coalesce("source_digest", F.lit("")), F.lit("\r\nsource-"),
        F.regexp_replace("http_headers", CRLF, "\r\nsource-"), F.lit(CRLF),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block")),
    )
    kept = [*keys, "target_uri", "date"]
    out = base.select(*kept, F.col("record_id").alias("refers_to"), "source_digest", F.col("http_headers").alias("source_headers"), F.explode(made).alias("r"))
    out = out.select(*kept, "refers_to", "source_digest", "source_headers", "r.*")
    return out.withColumns(
        {
            "record_id": record_id(F.col("record_type"), F.col("refers_to")),
            "content_length": F.octet_length("block").cast("long"),
            "block_digest": digest(F.col("block")),
        }
    )


def _record_text(fields: dict[str, Column], block: Column) -> Column:
    """A record as text; fields that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines), F.lit(CRLF * 2), block)


def response_text(source: DataFrame) -> DataFrame:
    """One column, value: responses as WARC/1.1 response records, ready for write.text(path, lineSep="\\r\\n\\r\\n")."""
    block = F.concat(F.coalesce("http_headers", F.lit("")), F.lit(CRLF * 2), F.coalesce("payload", F.lit("")))
    fields = {
        "WARC-Type": F.lit("response"), "WARC-Record-ID": F.col("record_id"), "WARC-Target-URI": F.col("target_uri"), "WARC-Date": F.col("date"),
        "WARC-Payload-Digest": F.col("payload_digest"), "Content-Type": F.lit("application/http;msgtype=response"), "Content-Length": F.octet_length(block).cast("string"),
    }
    return source.select(_record_text(fields, block).alias("value"))


def warc_text(records: DataFrame) -> DataFrame:
    """One column, value: records of derivatives() as WARC/1.1 text, ready for write.text(path, lineSep="\\r\\n\\r\\n").

    Each keeps its source's digest and headers, a line of them in a field X-Source-Header of its own.
    """
    headers = F.when(F.col("source_headers") != "", F.replace("source_headers", F.lit(CRLF), F.lit("\r\nX-Source-Header: ")))
    fields = {
        "WARC-Type": F.col("record_type"), "WARC-Record-ID": F.col("record_id"), "WARC-Refers-To": F.col("refers_to"), "WARC-Target-URI": F.col("target_uri"),
        "WARC-Date": F.col("date"), "WARC-Block-Digest": F.col("block_digest"), "X-Source-Payload-Digest": F.col("source_digest"), "X-Source-Header": headers,
        "Content-Type": F.col("content_type"), "Content-Length": F.col("content_length").cast("string"),
    }
    return records.select(_record_text(fields, F.col("block")).alias("value"))
