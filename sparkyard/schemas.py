"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

SEGMENTS = "video_id string, seg_idx int, start double, end double, text string"
FRAMES = "video_id string, frame_idx int, seconds int, ts string, path string"
OCR = "video_id string, ocr_idx int, ts string, tokens array<string>"
WINDOWS = "video_id string, window_idx int, window_start int, window_end int, label string, combined_text string"
RESPONSES = "video_id string, window_idx int, response string, input_tokens bigint, output_tokens bigint, error string"
VERDICTS = "video_id string, lot_number bigint, response string"
LOT = "lot_number bigint, sex string, category string, num_animals bigint, breed string, age_months bigint, unit_price double, total_price double, sold boolean, timestamp_start string, notes string"
LOTS = f"video_id string, {LOT}"
METADATA = "video_id string, date string, city string, auctioneer string, farm string, auction_type string, notes string"
VIDEO_INFO = "video_id string, title string, description string"
PRICES = "model string, input_price double, output_price double"
RUNS = "video_id string, provider string, model string, elapsed_seconds double, lot_count bigint, lots_with_price bigint, lots_without_price bigint, llm_calls bigint, input_tokens bigint, output_tokens bigint, status string, error string"
URLS = "ordinal int, line string"
