"""The queries of this package, by name, and their oracle SQL where SQL can express them."""

from tintwalk.llm import divergence, embeddings, fingerprints, interactions, language, mixing, packing, passages, preferences, sanitise, simhash, toxicity, urls

QUERIES = {
    "op1_fingerprints": fingerprints.op1,
    "op2_packing": packing.op2,
    "op3_mixing": mixing.op3,
    "op4_sanitise": sanitise.op4,
    "op5_simhash": simhash.op5,
    "op6_preferences": preferences.op6,
    "op7_embeddings": embeddings.op7,
    "op8_language": language.op8,
    "op9_toxicity": toxicity.op9,
    "op10_urls": urls.op10,
    "op11_divergence": divergence.op11,
    "op12_interactions": interactions.op12,
    "op13_passages": passages.op13,
}

#: The others have fitted models, hashes or tokenizers, or need iteration; their tests compare with brute force, round trips or held-out labels.
ORACLES = {
    "op6_preferences": preferences.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_interactions": interactions.ORACLE,
    "op13_passages": passages.ORACLE,
}
