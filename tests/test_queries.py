"""Some queries against their SQL on the smallest driver tables; the rest are compared by the driver."""

import math
from pathlib import Path

import pytest

from colloquy.plans.catalog import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "conversations events documents benchmark labels embeddings orders lineitem customer part nation pages".split()
CHOSEN = (
    "talk_time", "windowed_vote", "correlate", "merge_transcripts", "word_segments", "asof_chapter", "turn_audit", "wer_proxy", "gate_e", "quote_validation",
    "paragraph_chunks", "turn_windows", "topk_join", "reconcile", "answer_citations", "seq_dedupe",
    "references", "markdown_blocks", "export_markdown", "verification_tally", "clock_format", "clean_title", "artifact_writes", "vector_writes", "model_contracts", "candidate_region", "parsed_lines", "extraction_chunks", "fragment_prompt",
    "debounce", "gate_reasons", "participants", "replayed_captions", "fleet_hours", "window_priorities", "note_model", "meeting_chunks", "stream_captures", "stream_chrome", "stream_rates",
)


def plain(rows):
    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.5g}"
        return str(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, str(DATA))
    told = con.execute(ORACLES[name])
    columns = [c[0] for c in told.description]
    assert sorted(found.columns) == sorted(columns)
    assert plain(found.select(*columns).collect()) == plain(told.fetchall())
