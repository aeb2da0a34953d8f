"""Schemas of the tables that operators exchange."""

from __future__ import annotations

MANIFEST = "id string, path string, speaker_id string, sentence string, age string, gender string, accent string, locale string, upvotes bigint, downvotes bigint, source_split string"
CLIP = "id string, samples array<float>, sr int, load_error string"
QUALITY = "duration_sec double, snr_db double, silence_ratio double, rms_db double, is_clipped boolean, passes boolean, fail_reasons array<string>"
SYNTHETIC = "id string, path string, speaker_id string, sentence string, age string, gender string, accent string, locale string, duration_sec double, source string, tts_voice string"
PLAN = "plan_pos bigint, gender string, accent string, age_group string, voice_id string, n_samples bigint, texts array<string>, priority double"
ASSIGNMENT = "id string, canonical_id string, kind string"
