"""Invitations, and tying replies back to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.references import checksum_digits, quoted_token, reply_token
from bidloom.operators.names import names_in_texts
from bidloom.session import checkpoint

#: A name is found by this many characters; names that begin alike are then compared whole.
SNIPPET = 14
SHORTEST_NAME = 4
SALT_ROUNDS = 16


def invitations(requests: DataFrame, invited: DataFrame) -> DataFrame:
    """One row per (request, supplier) with its reply reference.

    `requests` has request_id, reference, title and line_count; `invited` has
    request_id, vendor and vendor_ord. References that coincide inside a request
    are salted and recomputed until all differ, keeping their shape. The checksum
    widens with the number of invitations, so fewer than one in a request is
    expected to coincide and every round settles all but a vanishing share of
    those: SALT_ROUNDS is far beyond what any input needs.
    """
    rows = invited.join(requests, "request_id").withColumn("salt", F.lit(0))
    digits = checksum_digits(invited.count())

    def tokens(df: DataFrame) -> DataFrame:
        salted = F.when(F.col("salt") == 0, F.col("vendor")).otherwise(F.concat_ws("#", "vendor", F.col("salt").cast("string")))
        return df.withColumn("token", reply_token(F.col("reference"), F.col("title"), salted, F.col("line_count"), digits))

    issued = tokens(rows)
    clash = F.row_number().over(Window.partitionBy("request_id", "token").orderBy("salt", "vendor_ord", "vendor")) > 1
    marked = checkpoint(issued.withColumn("clash", clash))
    rounds = 0
    while not marked.where("clash").isEmpty():
        rounds += 1
        if rounds > SALT_ROUNDS:
            raise ValueError("the same supplier is invited more than once to one request")
        salted = marked.withColumn("salt", F.when(F.col("clash"), F.col("salt") + 1).otherwise(F.col("salt")))
        again = tokens(salted.drop("token", "clash"))
        marked = checkpoint(again.withColumn("clash", clash))
    subject = F.concat(F.lit("Request for quotation — "), F.coalesce("title", F.lit("items attached")), F.lit(" ["), F.col("token"), F.lit("]"))
    attachment = F.concat(F.replace(F.coalesce("reference", F.lit("request")), F.lit("/"), F.lit("_")), F.lit(".pdf"))
    return marked.drop("clash", "salt").withColumns({"subject": subject, "attachment_name": attachment})


def attribute_replies(replies: DataFrame, invited: DataFrame) -> DataFrame:
    """Which invitation each reply answers, and on what basis: token, name or none.

    `replies` has reply_id and text; `invited` has vendor, vendor_ord and token. A quoted
    reference that matches nothing, or that several invitations carry, identifies
    nobody. A name counts only when it is long enough and the only one found. It
    is found by its first SNIPPET characters; of names that begin alike, those
    count that stand in the text whole, if any do, the longest of them before the
    ones it contains. Names and their beginnings are looked for by automata
    (`names.names_in_texts`); names that begin alike and of which none stands whole
    are one row per reply, however many they are.
    """
    read = replies.select("reply_id", "text", quoted_token("text").alias("token"))
    issued = invited.groupBy(F.upper("token").alias("token")).agg(F.count("*").alias("holders"), F.min("vendor").alias("vendor")).where("holders = 1").drop("holders")
    by_token = read.where(F.col("token").isNotNull()).select("reply_id", "token").join(issued, "token", "left").select(
        "reply_id", "vendor", F.when(F.col("vendor").isNotNull(), F.col("token")).alias("token"),
        F.when(F.col("vendor").isNotNull(), F.lit("token")).otherwise(F.lit("none")).alias("basis"),
    )

    name = F.lower(F.trim("vendor"))
    names = invited.where(F.length(F.trim("vendor")) >= SHORTEST_NAME).groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min("vendor").alias("vendor"))
    names = checkpoint(names.withColumn("snippet", F.substring("name", 1, SNIPPET)))
    plain = read.where(F.col("token").isNull())
    wanted = names.select("name").unionAll(names.select("snippet"))
    stands = checkpoint(names_in_texts(plain.select(F.col("reply_id").alias("id"), F.lower("text").alias("text")), wanted).select(F.col("id").alias("reply_id"), F.col("name").alias("found")))

    whole = stands.join(names, stands.found == names.name).select("reply_id", "snippet", "name", "n", "vendor")
    alike = names.groupBy("snippet").agg(F.sum("n").alias("n"), F.min("name").alias("name"), F.min("vendor").alias("vendor"))
    begun = stands.join(alike, stands.found == alike.snippet).select("reply_id", "snippet", "name", "n", "vendor").join(whole, ["reply_id", "snippet"], "left_anti")
    hits = whole.unionByName(begun).drop("snippet")
    longest = hits.groupBy("reply_id").agg(F.sum("n").alias("n"), F.max_by("vendor", F.length("name")).alias("vendor"), F.max_by("name", F.length("name")).alias("longest"), F.collect_set("name").alias("all"))
    only = F.forall("all", lambda x: F.col("longest").contains(x)) & (F.col("n") == F.size("all"))
    found = longest.where(only).select("reply_id", "vendor")
    by_name = plain.select("reply_id").join(found, "reply_id", "left").select(
        "reply_id", "vendor", F.lit(None).cast("string").alias("token"),
        F.when(F.col("vendor").isNotNull(), F.lit("name")).otherwise(F.lit("none")).alias("basis"),
    )
    return by_token.unionByName(by_name)


def credited(rows: DataFrame, attributed: DataFrame, key: str = "file") -> DataFrame:
    """Rows of a reply (key, vendor) under the supplier that was identified, else under the name read off it.

    `attributed` has key, vendor, token and basis, one row per reply. Adds `identified_by`,
    `token` (only where the reply quoted one) and `attribution_note`, which says so where
    the name read and the supplier identified differ.
    """
    known = attributed.select(key, F.col("vendor").alias("_known"), F.col("token").alias("_token"), F.col("basis").alias("identified_by"))
    read, known_as, basis = F.col("vendor"), F.col("_known"), F.col("identified_by")
    differs = known_as.isNotNull() & ~read.eqNullSafe(known_as)
    note = F.when(differs & (basis == "token"), F.concat(F.lit("Credited to "), known_as, F.lit(": the reply quotes the reference of that invitation."))).when(
        differs & (basis == "name"), F.concat(F.lit("Credited to "), known_as, F.lit(" by name alone; no reference was quoted, so this needs a second look."))
    )
    return rows.join(known, key, "left").select(
        *[F.coalesce("_known", "vendor").alias("vendor") if c == "vendor" else F.col(c) for c in rows.columns],
        F.coalesce("identified_by", F.lit("none")).alias("identified_by"), F.col("_token").alias("token"), note.alias("attribution_note"),
    )


def invitation_status(responded: Column, receipt_ok: Column) -> Column:
    return (
        F.when(responded, F.lit("responded")).when(receipt_ok, F.lit("sent")).when(~receipt_ok, F.lit("failed")).otherwise(F.lit("not sent"))
    )
