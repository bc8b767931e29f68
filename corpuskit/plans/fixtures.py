"""Test inputs made from the driver tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raw_mail_from_turns(turns: DataFrame, extra_folder: str | None = "archive") -> DataFrame:
    """Landing table ``(folder, seq, raw)`` built from a conversations table.

    folder = role, seq = conv_id * 1000 + turn. Every 5th turn has no Message-Id (the
    fallback id path); every 7th turn is copied into ``extra_folder`` as well.
    """
    no_id = F.col("turn") % 5 == 0
    mid_line = F.when(no_id, F.lit("")).otherwise(
        F.concat(F.lit("Message-Id: <"), F.col("conv_id").cast("string"), F.lit("."),
                 F.col("turn").cast("string"), F.lit("@example.org>\n")))
    raw = F.concat(mid_line,
                   F.lit("Subject: "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"),
                   F.lit('From: "'), F.col("role"), F.lit('" <'), F.col("role"), F.lit("@example.org>\n"),
                   F.lit("To: list@example.org\nDate: Mon, 01 Jan 2024 00:00:00 +0000\n"),
                   F.lit("Content-Type: text/plain; charset=utf-8\n\n"),
                   F.coalesce(F.col("text"), F.lit("")), F.lit("\n")).cast("binary")
    base = turns.select(F.col("role").alias("folder"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
                        raw.alias("raw"), F.col("turn"))
    if extra_folder is None:
        return base.drop("turn")
    copies = base.where(F.col("turn") % 7 == 0).withColumn("folder", F.lit(extra_folder))
    return base.unionByName(copies).drop("turn")


def mime_mail_from_turns(turns: DataFrame) -> DataFrame:
    """Landing table of MIME mail, one message a turn, in three shapes by ``turn % 3``: 0 a base64 plain part
    with an html alternative; 1 an html part with a script, and a text attachment; 2 two plain parts, of
    which the first names a charset that nobody knows. Subjects and senders are encoded words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base64 = lambda c: F.regexp_replace(F.base64(c.cast("binary")), r"\s", "")
    subject = F.concat(F.lit("Ré: "), F.col("role"), F.lit(" "), F.col("turn").cast("string"))
    head = F.concat(
        F.lit("Message-Id: <m"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit("@example.org>\n"),
        F.lit("Subject: =?utf-8?B?"), base64(subject), F.lit("?=\nFrom: =?utf-8?q?J=C3=BCrgen?= <"), F.col("role"),
        F.lit("@example.org>\nTo: list@example.org\nDate: Mon, 01 Jan 2024 00:00:00 +0000\nMIME-Version: 1.0\n"))
    part = lambda kind, body: F.concat(F.lit(f"--=-b-=\nContent-Type: {kind}\n"), body, F.lit("\n"))
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    plain = F.concat(part("text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n", base64(text)),
                     part("text/html\n", F.lit("<p>the other form</p>")))
    html = F.concat(part("text/html; charset=utf-8\n", F.concat(
                        F.lit("<html><body><script>var a = '<p>';</script><p>"), escaped, F.lit("</p></body></html>"))),
                    part("text/plain\nContent-Disposition: attachment; filename=a.txt\n", F.lit("not of the body")))
    two = F.concat(part("text/plain; charset=x-nobody\n", text), part("text/plain\n", F.lit("second part")))
    shape = F.col("turn") % 3
    kind = F.when(shape == 0, F.lit("alternative")).otherwise(F.lit("mixed"))
    raw = F.concat(head, F.lit("Content-Type: multipart/"), kind, F.lit('; boundary="=-b-="\n\n'),
                   F.when(shape == 0, plain).when(shape == 1, html).otherwise(two), F.lit("--=-b-=--\n"))
    return turns.select(F.col("role").alias("folder"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
                        raw.cast("binary").alias("raw"))
