"""Events to content rows, and exported chat texts to messages."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.scan import running
from chatloom.schemas import CHAT_SOURCE, MESSAGE_TYPES, MIME_TYPES

#: The forms that an exported chat's lines have.
STAMP = r"\d{1,2}/\d{1,2}/\d{2,4},\s*\d{1,2}:\d{2}(?:\s*[AP]M)?"
SENT = rf"^({STAMP})\s*-\s*([^:]+?):\s*(.*)$"
STATED = rf"^({STAMP})\s*-\s*(.+)$"
OMITTED = r"(?i)(image|video|audio|document|sticker)\s+omitted"


def blank_to_null(c: Column) -> Column:
    """The value as it is, or null if it is blank."""
    return F.when(F.trim(c) != "", c)


def parse_time(c: Column) -> Column:
    """ISO-8601 with offset, ``Z`` or none (UTC); anything else is null."""
    return F.try_to_timestamp(F.trim(c))


def content_type(message_type: Column, mime: Column) -> Column:
    """Content type of a message type; ``document`` is refined by its media type, parameters dropped."""
    kind = F.lower(F.coalesce(F.when(message_type != "", message_type), F.lit("unknown")))
    by_kind, by_mime = (F.create_map(*map(F.lit, chain(*m.items()))) for m in (MESSAGE_TYPES, MIME_TYPES))
    bare = F.trim(F.split(F.lower(mime), ";")[0])
    refined = F.when(kind == "document", F.element_at(by_mime, bare))
    return F.coalesce(refined, F.element_at(by_kind, kind), F.lit("document"))


def event_kind(is_deleted: Column, is_edited: Column) -> Column:
    return F.when(F.coalesce(is_deleted, F.lit(False)), "delete").when(F.coalesce(is_edited, F.lit(False)), "edit").otherwise("new")


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(usable, rejected)``: rejected events lack an id or a readable time; the reason is a column."""
    reason = (
        F.when(F.coalesce(F.trim("account_id"), F.lit("")) == "", "missing account id")
        .when(F.coalesce(F.trim("chat_id"), F.lit("")) == "", "missing chat id")
        .when(F.coalesce(F.trim("message_id"), F.lit("")) == "", "missing message id")
        .when(parse_time(F.col("timestamp")).isNull(), "bad timestamp")
    )
    judged = events.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def normalize(events: DataFrame) -> DataFrame:
    """One row for each piece of content of a usable event: text or link, attachment, or the mark of a deletion.

    A deleted message is one ``system`` row. Else text gives a row (``link`` if it holds a web address; of a media
    message without attachment it keeps the media's type) and an attachment one without text, its id ending in
    ``:attachment``. Without either there is no row.
    """
    usable, _ = split_events(events)
    has_text = F.coalesce(F.trim("text"), F.lit("")) != ""
    has_att = F.col("attachment").isNotNull()
    own = content_type(F.col("message_type"), F.col("attachment.mime_type"))
    linked = F.col("text").contains("http://") | F.col("text").contains("https://")
    media = ~own.isin("text", "link") & ~has_att
    text_type = F.when(media, own).when(linked, "link").otherwise("text")
    deleted = F.coalesce(F.col("is_deleted"), F.lit(False))

    def part(kind: Column, text: Column, suffix: str, attachment: Column) -> Column:
        return F.struct(kind.alias("content_type"), text.alias("text"), F.concat("message_id", F.lit(suffix)).alias("source_message_id"), attachment.alias("attachment"))

    none = F.lit(None).cast("string")
    no_att = F.when(F.lit(False), F.col("attachment"))
    parts = F.array(
        F.when(deleted, part(F.lit("system"), none, "", no_att)),
        F.when(~deleted & has_text, part(text_type, F.col("text"), "", no_att)),
        F.when(~deleted & has_att, part(own, none, ":attachment", F.col("attachment"))),
    )
    rows = usable.withColumn("part", F.explode(F.filter(parts, lambda x: x.isNotNull())))
    return rows.select(
        *(["owner_id"] if "owner_id" in events.columns else []), F.lit(CHAT_SOURCE).alias("source"), F.col("account_id").alias("source_account_id"), F.col("chat_id").alias("conversation_id"),
        F.col("part.source_message_id").alias("source_message_id"), blank_to_null(F.col("sender_id")).alias("sender_id"), blank_to_null(F.col("sender_name")).alias("sender_name"),
        F.col("part.content_type").alias("content_type"), F.col("part.text").alias("text"), parse_time(F.col("timestamp")).alias("ts"), F.col("part.attachment").alias("attachment"),
        *([parse_time(F.col("edited_at")).alias("edited_at")] if "edited_at" in events.columns else []), F.coalesce("is_edited", F.lit(False)).alias("is_edited"), deleted.alias("is_deleted"), event_kind(F.col("is_deleted"), F.col("is_edited")).alias("kind"),
    ).withColumns({
        "stable_id": stable_id(),
        "has_text": F.coalesce(F.trim("text"), F.lit("")) != "",
        "has_attachment": F.col("attachment").isNotNull(),
    }).withColumn("is_indexable", ~F.col("is_deleted") & (F.col("has_text") | F.col("has_attachment")))


def stable_id(source: str = "source", account: str = "source_account_id", chat: str = "conversation_id", message: str = "source_message_id") -> Column:
    return F.concat_ws(":", source, account, chat, message)


def vector_id(account: Column, chat: Column, message: Column, part: Column, index: Column) -> Column:
    """The id of one chunk of a message; it does not change with the message's version."""
    return F.concat_ws(":", F.lit(CHAT_SOURCE), account, chat, message, part, index.cast("string"))


def segment(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, message_no, message, n_lines, fallback_split`` of exported chat texts.

    A line that begins with a time stamp and a dash opens a message and the lines up to the next one belong to it. A text
    without such lines has one message for each line that isn't blank, and is flagged. One window over the lines of a text.
    """
    lines = texts.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]")).alias("pos", "line"))
    lines = lines.withColumn("opens", F.col("line").rlike(SENT) | F.col("line").rlike(STATED))
    whole, upto = Window.partitionBy("key"), Window.partitionBy("key").orderBy("pos")
    lines = lines.withColumn("fallback_split", ~F.max("opens").over(whole))
    lines = lines.where(~F.col("fallback_split") | (F.trim("line") != ""))
    starts = F.when(F.col("opens") | F.col("fallback_split") | (F.row_number().over(upto) == 1), 1).otherwise(0)
    lines = lines.withColumn("starts", starts).withColumn("message_no", F.sum("starts").over(upto) - 1)
    joined = lines.groupBy("key", "message_no").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("own"), F.first("fallback_split").alias("fallback_split"))
    text_of = F.array_join(F.transform("own", lambda x: x["line"]), "\n")
    return joined.select(F.col("key").alias(key), "message_no", text_of.alias("message"), F.size("own").alias("n_lines"), "fallback_split")


def segment_lines(lines: DataFrame, keys: list[str], order: list[str], line: str = "line") -> DataFrame:
    """What ``segment`` finds, of texts that come as one row a line: ``keys, message_no, message, n_lines, fallback_split``.

    An export of any length is cut by a running count of the lines that open a message, computed in parts of the lines (``scan.running``); a
    message that goes on from one part to the next is one message. ``order`` gives the lines' order within a text, without ties. What is
    asked of a whole text (does any line open a message, does its first one) is one aggregate a text.
    """
    marked = lines.withColumn("_opens", F.coalesce(F.col(line).rlike(SENT) | F.col(line).rlike(STATED), F.lit(False)))
    per = marked.groupBy(*keys).agg((~F.bool_or("_opens")).alias("fallback_split"), F.min_by("_opens", F.struct(*order)).alias("_first_opens"))
    same = None
    for i, k in enumerate(keys):
        one = F.col(k).eqNullSafe(F.col(f"_key{i}"))
        same = one if same is None else same & one
    met = marked.join(per.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)}), same).where(~F.col("fallback_split") | (F.trim(line) != ""))
    met = met.select(*keys, *order, line, "fallback_split", "_first_opens", (F.col("_opens") | F.col("fallback_split")).cast("bigint").alias("_starts"))
    counted = running(met, keys, order, {"_opened": (F.col("_starts"), F.sum)}, "lines")
    number = F.col("_opened") - 1 + F.when(F.col("fallback_split") | F.col("_first_opens"), 0).otherwise(1)
    rows = counted.withColumn("message_no", number).groupBy(*keys, "message_no").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("_line")))).alias("_own"), F.first("fallback_split").alias("fallback_split"))
    return rows.select(*keys, "message_no", F.array_join(F.transform("_own", lambda x: x["_line"]), "\n").alias("message"), F.size("_own").alias("n_lines"), "fallback_split")


def parse_line(line: Column) -> dict[str, Column]:
    """Time stamp, sender and body of a message's first line."""
    sent = line.rlike(SENT)
    return {
        "stamp": blank_to_null(F.regexp_extract(line, STATED, 1)),
        "sender": F.when(sent, F.regexp_extract(line, SENT, 2)),
        "body": F.when(sent, F.regexp_extract(line, SENT, 3)).when(line.rlike(STATED), F.regexp_extract(line, STATED, 2)).otherwise(line),
    }


def chat_time(stamp: Column) -> Column:
    """Time of an exported line: 12-hour, else 24-hour clock, with a year of four digits; else null."""
    return F.coalesce(F.try_to_timestamp(stamp, F.lit("M/d/yyyy, h:mm a")), F.try_to_timestamp(stamp, F.lit("M/d/yyyy, H:mm")))


def chunk_stats(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """What a stored chunk says about its messages: counts, participants, time span, kinds of attachments left out."""
    rows = segment(texts, key, text)
    first = F.split("message", "\n")[0]
    rows = rows.withColumns(parse_line(first)).withColumn("ts", chat_time(F.col("stamp"))).withColumn("left_out", F.lower(F.regexp_extract("message", OMITTED, 1)))
    has = {"images": "image", "audio": "audio", "video": "video", "documents": "document"}
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("message_count"), F.count_if(F.col("left_out") != "").alias("attachment_count"), *(F.bool_or(F.col("left_out") == kind).alias(f"contains_{name}") for name, kind in has.items()),
        F.array_join(F.array_sort(F.collect_set("sender")), ",").alias("participants"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("start_timestamp"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("end_timestamp"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("duration_seconds"),
        F.round(F.avg(F.char_length("message")), 6).alias("average_message_length"),
    )
