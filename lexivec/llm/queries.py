"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import centroids, changepoints, embeddings, jaccard, line_dedup, media, mixing, pieces, secrets, sharding, token_ids, toxicity, word_bpe

QUERIES = {
    "op1_token_ids": token_ids.op1_token_ids,
    "op2_mixing": mixing.op2_mixing,
    "op3_sharding": sharding.op3_sharding,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_media": media.op5_media,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_embedding_dedup": embeddings.op9_embedding_dedup,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_word_bpe": word_bpe.op11_word_bpe,
    "op12_change_points": changepoints.op12_change_points,
    "op13_centroids": centroids.op13_centroids,
}
SQL: dict[str, str] = {"op7_line_dedup": line_dedup.OP7_SQL, "op12_change_points": changepoints.OP12_SQL, "op13_centroids": centroids.OP13_SQL}
