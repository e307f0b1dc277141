"""The queries that apply each operator of this subpackage to its whole table, and their SQL where there is any."""

from __future__ import annotations

from . import editprint, lines, media, mixing, pieces, pivots, quality, runs, secrets, simhash, toxicity, turns, urls

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_media": media.op2_media,
    "op3_lines": lines.op3_lines,
    "op4_pieces": pieces.op4_pieces,
    "op5_urls": urls.op5_urls,
    "op6_quality": quality.op6_quality,
    "op7_mixing": mixing.op7_mixing,
    "op8_editprint": editprint.op8_editprint,
    "op9_secrets": secrets.op9_secrets,
    "op10_simhash": simhash.op10_simhash,
    "op11_pivots": pivots.op11_pivots,
    "op12_runs": runs.op12_runs,
    "op13_turns": turns.op13_turns,
}

ORACLES: dict[str, str] = {
    "op7_mixing": mixing.oracle(),
    "op9_secrets": secrets.oracle(),
    "op11_pivots": pivots.oracle(),
    "op13_turns": turns.oracle(),
}
