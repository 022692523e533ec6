"""Registered queries of the corpus operators, on the whole test tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvecal.llm import (conversation_trie, decontaminate, hamming, hard_negatives, html_diff, jaccard_join, language, piece_bpe,
                          quality, secrets, sqltext, suffix_dedup, token_files, url_reputation)
from curvecal.llm.common import table, text_or_empty
from curvecal.session import materialize, ship_package

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark, folder):
            ship_package(spark)
            return fn(spark, folder)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return add


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def page_outcomes(spark, folder) -> DataFrame:
    """Quality labels as outcomes of pages: a page's path ends in the number of its document, with or without a slash."""
    number = F.regexp_extract(url_reputation.url_path(F.col("url")), "/([0-9]+)[^/0-9]*/?$", 1)
    pages = table(spark, folder, "pages").select("url", number.try_cast("bigint").alias("doc_id"))
    return pages.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id").select(
        "url", F.col("quality").alias("good"))


@query("op1_url_reputation", sqltext.OP1)
def op1(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    out = url_reputation.judge_urls(pages, page_outcomes(spark, folder), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "n_labelled",
                      *(F.round(c, 6).alias(c) for c in ("rate", "low", "high")))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_piece_coding")
def op2(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ids = piece_bpe.encode(docs, piece_model()).select("doc_id", "ids")
    return piece_bpe.decode(ids, piece_model()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op3_suffix_dedup", sqltext.OP3)
def op3(spark, folder):
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes",
        F.expr("CAST(aggregate(spans, 0L, (a, x) -> a + x.end - x.start) AS bigint)").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_secret_scan")
def op4(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs).select("doc_id", "spans")

    def count(kind):
        return F.expr(f"CAST(size(filter(spans, x -> x.kind = '{kind}')) AS bigint)").alias(f"n_{kind}")

    def listed(which):
        return F.expr(f"array_join(transform({which}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed("filter(spans, x -> x.kind IN ('assign', 'access', 'hex'))"), 256).alias("base_sha256"),
        listed("spans").alias("spans"))


@query("op5_jaccard_join", sqltext.OP5)
def op5(spark, folder):
    found = jaccard_join.link_components(table(spark, folder, "documents"), n=4, num=85, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query("op6_page_difference")
def op6(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_diff.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op7_decontaminate")
def op7(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id", "item_id", F.round("score", 6).alias("score"), F.round("question_overlap", 6).alias("question_overlap"),
        F.round("answer_overlap", 6).alias("answer_overlap"), "first_word")


@query("op8_language_codes")
def op8(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("held_out"))
    codes = language.fit(docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return language.predict(docs.select("doc_id", "text", "held_out"), codes).select(
        "doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"), "ambiguous")


@query("op9_hamming_topk", sqltext.OP9)
def op9(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), hamming.sign_code("embedding").alias("code"))
    return hamming.top_k(rows, rows.where("id % 20 = 0"))


@query("op10_quality_classifier")
def op10(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.fit(docs)).select(
        "doc_id", F.round("quality_score", 6).alias("quality_score"), "keep")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op11_token_files")
def op11(spark, folder):
    files = token_files.write(table(spark, folder, "documents").select("doc_id", "text"), byte_tokenizer(), end_id=2)
    return token_files.read(files).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op12_conversation_trie", sqltext.OP12)
def op12(spark, folder):
    sequences = conversation_trie.encode_turns(table(spark, folder, "conversations"))
    rebuilt = conversation_trie.share_heads(
        sequences, F.expr("conv_id - conv_id % 100"), F.expr("crc32(CAST(conv_id AS string)) % 6"))
    return conversation_trie.build(materialize(rebuilt, "rebuilt")).drop("turn_id")


@query("op13_hard_negatives", sqltext.OP13)
def op13(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"),
        hard_negatives.scaled("embedding", 256).alias("vector"))
    return hard_negatives.mine(rows, rows.where("id % 100 = 0"))
