"""The relations of the engine as DDL. Every relation is partitioned by page; ord is the total order of a page's readings."""

from __future__ import annotations

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"
POINTS = "array<struct<x:int,y:int>>"

PAGES = "page int, width int, height int, source string, source_page_index int, method string, text_layer_chars int, sha1 string"
TILES = f"page int, tile_id string, box {BOX}"
CONTEXTS = (
    "page int, model string, sheet_id string, title string, sheet_type string, revision string, system_prefixes array<struct<code:string,meaning:string>>, "
    f"symbols array<struct<shape:string,meaning:string>>, suppress_regions array<struct<kind:string,bbox:{BOX}>>, notes array<string>, scale_applied double, cost double"
)
REGIONS = f"page int, ord bigint, bbox {BOX}, score double, poly {POINTS}, text string, text_score double, tile_id string"
OBSERVATIONS = (
    f"page int, ord bigint, text string, kind string, symbol string, attached_to string, line_color string, bbox {BOX}, confidence double, tile_id string, model string, sub_tile int"
)
RULINGS = "page int, gi bigint, present boolean, text string, kind string, symbol string, attached_to string, confidence double, model string"
VERDICTS = f"page int, model string, category string, tag_key string, answer string, evidence string, question_hash string, tag string, bbox {BOX}"
FLAGS = f"page int, model string, key string, letter string, evidence string, value string, bbox {BOX}"
ANSWERS = "page int, category string, value string"
TABLE_READS = (
    f"page int, table_index int, reader string, title string, bbox {BOX}, kind string, header_rows int, rows array<array<string>>, notes string, read_scale double, n_rows int, n_cols int"
)
ANSWER_KEY = "document_id int, category string, value string"
DECISIONS = "page int, id string, action string, corrected string, note string, by string, at timestamp"
CALLS = (
    "layer string, role string, tile string, model string, provider string, effort string, status string, latency double, ttft double, "
    "input_tokens bigint, output_tokens bigint, cost double, error string, at timestamp"
)
MODELS = "model string, provider string, tier string, price_in double, price_out double, note string, supports_effort boolean"
RUNS = "page int, run_at timestamp, sheet_id string, model string, recall double, matched bigint, missed bigint, coverage double, cost double, seconds double"
CHANGELOG = "page int, sheet_id string, action string, category string, idx int, before string, after string, reason string, source string, by string, at timestamp, previous_version string"

# The closed sets of words that readings are given in.
KINDS = ["valve", "instrument_bubble", "continuation_connection", "boundary_interface", "equipment", "line_label", "annotation", "other"]
ZONE_KINDS = ["notes", "legend", "title_block", "revision_table", "other"]
ACTIONS = ["accept", "reject", "correct"]
STAGE_STATES = ["waiting", "running", "done", "pending", "blocked", "error"]
