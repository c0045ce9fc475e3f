"""Values that must be as they are for right results; fixed values, by session mode where noted."""

from __future__ import annotations

MODES = ("precision", "validation", "analogy", "exploration")

# Fixed values per mode, in the order of MODES.
SIMILARITY_THRESHOLD = dict(zip(MODES, (0.7, 0.6, 0.5, 0.5), strict=True))
MAX_TOKENS = dict(zip(MODES, (1024, 2048, 2048, 2048), strict=True))
RERANK_FLOOR = dict(zip(MODES, (0.05, 0.03, 0.02, 0.01), strict=True))
MAX_RESULTS = dict(zip(MODES, (3, 5, 5, 10), strict=True))
STRENGTH_FLOOR = dict(zip(MODES, (0.05, 0.1, 0.05, 0.0), strict=True))
BOOSTED = dict(zip(MODES, ("task_relevance", "surprise", None, "novelty"), strict=True))
LINK_POLICY = dict(zip(MODES, ("ignore", "ignore", "prefer", "follow"), strict=True))
DEPTH = dict(zip(MODES, (1, 2, 2, 3), strict=True))
SEEDS = dict(zip(MODES, (5, 10, 10, 20), strict=True))
RECONSOLIDATION_BUDGET = dict(zip(MODES, (5, 50, 25, 15), strict=True))
SCHEMA_WEIGHT = dict(zip(MODES, (1.2, 1.0, 1.1, 0.8), strict=True))
ENGRAM_WEIGHT = dict(zip(MODES, (0.9, 1.0, 1.0, 1.2), strict=True))
AGENT_WEIGHT = dict(zip(MODES, (0.7, 0.5, 0.3, 0.3), strict=True))
SHARED_WEIGHT = dict(zip(MODES, (0.3, 0.5, 0.7, 0.7), strict=True))
GATE = dict(zip(MODES, (0.25, 0.20, 0.20, 0.15), strict=True))
R_BASE = dict(zip(MODES, (0.8, 0.6, 0.4, 0.3), strict=True))
PUSH_THRESHOLD = dict(zip(MODES, (0.01, 0.001, 0.001, 0.0001), strict=True))
PUSH_TOP_K = dict(zip(MODES, (10, 20, 20, 30), strict=True))
TIER_DECAY = dict(zip(MODES, (0.90, 0.95, 0.95, 0.97), strict=True))

#: Score terms and their weights per mode, in the order of MODES.
SCORE_TERMS = ("rerank", "rrf", "temporal", "recency", "strength", "thalamus", "tags")
SCORE_WEIGHTS = {
    "precision": (0.48, 0.12, 0.05, 0.05, 0.05, 0.10, 0.15),
    "validation": (0.27, 0.08, 0.10, 0.05, 0.10, 0.30, 0.10),
    "analogy": (0.27, 0.23, 0.05, 0.05, 0.10, 0.25, 0.05),
    "exploration": (0.17, 0.13, 0.10, 0.10, 0.15, 0.30, 0.05),
}
FALLBACK_WEIGHTS = {"rerank": 0.6, "rrf": 0.2, "temporal": 0.1, "recency": 0.1}
#: Weights of the four gate dimensions per mode: novelty, surprise, task relevance, emotional valence.
DIMENSIONS = ("novelty", "surprise", "task_relevance", "emotional_valence")
GATE_WEIGHTS = {
    "precision": (0.15, 0.2, 0.45, 0.2),
    "validation": (0.2, 0.4, 0.2, 0.2),
    "analogy": (0.3, 0.2, 0.3, 0.2),
    "exploration": (0.4, 0.2, 0.2, 0.2),
}
#: Edge types of the push patterns, from semantic and from temporal seeds.
PATTERNS = {
    "default": ((("semantic", "semantic"), ("entity", "temporal"), ("semantic", "causes"), ("semantic", "caused_by"), ("entity", "semantic")), (("temporal", "semantic"), ("temporal", "entity"))),
    "precision": ((("semantic",), ("entity", "semantic")), (("temporal",),)),
    "exploration": ((("semantic", "semantic"), ("entity", "temporal"), ("co_activated", "semantic"), ("temporal_proximity", "entity")), (("temporal", "semantic"), ("temporal", "entity"))),
    "analogy": ((("schema", "entity"), ("schema", "semantic"), ("semantic", "schema")), (("temporal", "semantic"),)),
    "validation": ((("causes", "entity"), ("caused_by", "semantic"), ("contradiction", "semantic")), (("temporal", "semantic"),)),
}
CAUSAL_BOOST = {"causes": 2.0, "caused_by": 2.0, "enables": 1.5, "prevents": 1.5}
PROMOTE_THRESHOLD = {"fact": 0.7, "experience": 0.35, "opinion": 0.35}
DISPOSITIONS = {"neutral": (1.0, 0.0, 0.0), "analytical": (1.2, 0.0, 0.3), "optimistic": (0.8, 0.2, 0.5), "conservative": (0.8, 0.0, 0.7)}
LINK_TYPES = ("semantic", "temporal", "temporal_proximity", "entity", "causes", "caused_by", "enables", "prevents", "co_activated", "schema", "contradiction", "prediction_error", "specializes")
#: Stop words of query tags, German and English: fixed values.
STOPWORDS = """
aber alle als also auch auf aus bei bin bis bist das dass dein deine dem den der des die dies dir doch dort durch ein eine einen einer
eines etwa euch euer eure für gegen haben hast hat hatte ich ihm ihn ihr ist kann kein keine man mein meine mich mir mit nach nein nicht
noch nun nur ohne oder schon sehr sein seine sich sie sind soll sondern über und uns unser vom von vor war waren was weil wenn wer wie
will wir wird wo zu zum zur
and are but for from had has have her him his how its not now off our out she some than that the their them then there these they this
those was were what when where which who why will with you your
""".split()
CAPACITY = {"focus": 5, "supporting": 10, "peripheral": 20}
