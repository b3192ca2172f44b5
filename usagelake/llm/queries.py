"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from usagelake.llm import (
    automata, brown, classifier, content, fingerprints, jaccard, mixing, negatives, packing, phrases, quality, transforms, urls,
)

QUERIES = {f.__name__: f for f in (
    packing.op1_shortest_pack_first, fingerprints.op2_merkle_fingerprints, jaccard.op3_bayesian_jaccard_join,
    automata.op4_suffix_automata, quality.op5_line_frequency, urls.op6_path_templates, content.op7_random_field,
    mixing.op8_entropy_mix, transforms.op9_merged_transforms,
    brown.op10_brown_classes, classifier.op11_fourier_classifier,
    negatives.op12_angular_negatives, phrases.op13_suffix_collocations,
)}
ORACLES: dict[str, str] = {f.__name__: sql for f, sql in (
    (automata.op4_suffix_automata, automata.ORACLE), (negatives.op12_angular_negatives, negatives.ORACLE),
    (phrases.op13_suffix_collocations, phrases.ORACLE),
)}
