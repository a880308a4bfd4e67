"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers

from churnlens.llm import decontaminate, langid, merkle, mixing, neighbours, oracle, prefixtrie, pseudonyms, quality, secrets, simhash, substrings, tokens, toxicity
from churnlens.llm.common import table

#: A run's own key comes from its secret store; this one makes the registered query repeatable.
PSEUDONYM_KEY = "registered-query"


def op1_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op2_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(vectors["vec_id"] % 50 == 0), k=5)


def op4_token_orc(spark, sf_dir):
    return tokens.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_repeats(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op6_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


#: Token weights of the languages that the mixture should have.
MIX_TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def op9_mixing(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX_TARGETS)
    return out.select("doc_id", "n_tokens", "domain", "rate", "n_copies", "p", "reached")


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_merkle(spark, sf_dir):
    return merkle.tampered_audit(table(spark, sf_dir, "documents"))


def op12_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op13_prefix_trie(spark, sf_dir):
    return prefixtrie.rebuilt_trie(table(spark, sf_dir, "conversations"))


LLM_QUERIES = {f.__name__: f for f in (
    op1_pseudonyms, op2_secret_scan, op3_neighbours, op4_token_orc, op5_repeats, op6_decontaminate, op7_simhash, op8_toxicity, op9_mixing, op10_quality,
    op11_merkle, op12_language, op13_prefix_trie)}
LLM_ORACLE: dict[str, str] = {"op6_decontaminate": oracle.DECONTAMINATE, "op11_merkle": oracle.MERKLE, "op13_prefix_trie": oracle.PREFIX_TRIE}
