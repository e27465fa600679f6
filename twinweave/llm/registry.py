"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from twinweave.llm import (
    ball_tree,
    best_fit,
    chat,
    collocations,
    decontaminate,
    html_text,
    lattice_lm,
    packing,
    pii,
    sharding,
    simhash,
    sketch,
    toxicity,
)

QUERIES = {
    "op1_pii": pii.query,
    "op2_chat": chat.query,
    "op3_toxicity": toxicity.query,
    "op4_decontamination": decontaminate.query,
    "op5_simhash": simhash.query,
    "op6_lattice_lm": lattice_lm.query,
    "op7_html_text": html_text.query,
    "op8_packing": packing.query,
    "op9_sharding": sharding.query,
    "op10_sketch": sketch.query,
    "op11_ball_tree": ball_tree.query,
    "op12_collocations": collocations.query,
    "op13_best_fit": best_fit.query,
}

#: Those that SQL can express; the others are tested against brute force in tests/llm.
ORACLES = {"op2_chat": chat.ORACLE_SQL, "op11_ball_tree": ball_tree.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL}
