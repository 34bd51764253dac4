"""The registered queries of this package, with their SQL where it can say the same."""

from pyspark.sql import functions as F

from candlewright.llm import clustering, decontaminate, langid, licences, mixing, neighbours, pii, prefixtrie, secrets, sharding
from candlewright.llm import simhash, sketches, sqltext, tokenfiles
from candlewright.llm.common import scratch_path, table

QUERIES, SQL = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_simhash(spark, folder):
    found = simhash.simhash_components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_histogram_shards(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.histogram_shards(docs, carry=["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_mixing(spark, folder):
    return mixing.mixed_sizes(table(spark, folder, "documents"))


@query
def op10_token_files(spark, folder):
    path = tokenfiles.write_token_file(table(spark, folder, "documents"), scratch_path(spark))
    return tokenfiles.read_token_file(spark, path)


@query
def op7_language(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(langid.FOLDS)) == 0
    found = langid.identified(docs.select("doc_id", "text"), langid.fitted(docs))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


@query
def op5_decontamination(spark, folder):
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op2_neighbours(spark, folder):
    return neighbours.nearest(table(spark, folder, "embeddings"), "vec_id % 50 = 0")


@query
def op3_licences(spark, folder):
    return licences.licence_report(table(spark, folder, "documents"))


@query
def op6_secrets(spark, folder):
    return secrets.secrets(table(spark, folder, "documents"))


@query
def op4_personal_data(spark, folder):
    return pii.personal_data(table(spark, folder, "documents"))


@query
def op11_centroid_clusters(spark, folder):
    return clustering.clusters_of(table(spark, folder, "embeddings"))


@query
def op12_sketches(spark, folder):
    return sketches.edited_likeness(table(spark, folder, "documents"))


@query
def op13_prefix_trie(spark, folder):
    return prefixtrie.prefix_trie(table(spark, folder, "conversations"))


SQL["op11_centroid_clusters"] = sqltext.clusters_sql()
SQL["op13_prefix_trie"] = sqltext.prefix_trie_sql()
