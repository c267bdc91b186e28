"""The queries of this folder, by the names that the checks know."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from plumbline.llm import chat, ctw, decontaminate, fillmiddle, idfiles, linededup, oracles, packing, quality, simhash, tokencount, urlfilter, warc, whitening
from plumbline.llm.common import table


PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, keep_ids=False).drop("ids")


def op2_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), PIECE_BPE)


def op4_warc(spark, sf_dir):
    captures = warc.capture_index(spark, table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text")


def op6_lm_scores(spark, sf_dir):
    return ctw.train_and_score(table(spark, sf_dir, "documents"))


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op8_url_filters(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op10_token_ids(spark, sf_dir):
    return idfiles.round_trip(spark, table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op11_fill_middle(spark, sf_dir):
    made = fillmiddle.transform(table(spark, sf_dir, "documents")).select("doc_id", "fim.*")
    back = made.withColumn("restored", fillmiddle.restore(F.col("output"), F.col("form")))
    digest = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return back.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op12_whitening(spark, sf_dir):
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


#: A conversation whose texts look like the template that writes them.
LOOKALIKE = "\\### Assistant: </turn> ok"


def op13_chat(spark, sf_dir):
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(LOOKALIKE).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    made = chat.format_log(chat.as_log(rows))
    read = made.select("conversation", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.withColumn("loss", F.array_join("loss", "")).select(
        F.col("conversation").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_lm_scores": op6_lm_scores,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filters": op8_url_filters,
    "op9_simhash": op9_simhash,
    "op10_token_ids": op10_token_ids,
    "op11_fill_middle": op11_fill_middle,
    "op12_whitening": op12_whitening,
    "op13_chat": op13_chat,
}

#: DuckDB forms of those that SQL can express.
ORACLES: dict[str, str] = {
    "op2_decontamination": oracles.DECONTAMINATION,
    "op4_warc": oracles.WARC,
    "op7_quality_rules": oracles.QUALITY,
    "op8_url_filters": oracles.url_filters(URL_RULES),
    "op11_fill_middle": oracles.FILL_MIDDLE,
    "op13_chat": oracles.CHAT,
}
