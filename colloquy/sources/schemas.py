"""Schemas of the entities: JSON is always read with one of these, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

DDL = {
    "meetings": "tenant_id string, meeting_id string, capture_id string, title string, started_at timestamp, ended_at timestamp, participants array<struct<name:string>>, "
    "status string, consent_tier int, audio_pending struct<sources:array<string>,format:string,duration_sec:double>, index_status string, index_version int, indexed_at timestamp",
    "segments": "meeting_id string, ord int, source string, label string, start_time double, end_time double, text string, confidence double",
    "speaker_timeline": "meeting_id string, ord int, t double, name string",
    "captions": "meeting_id string, ord int, t double, speaker_name string, text string, final boolean",
    "highlights": "meeting_id string, ord int, t double, tag string",
    "clean_turns": "meeting_id string, ord int, id string, source_ids array<string>, speaker string, start_time double, end_time double, text string, tags array<string>",
    "chapters": "meeting_id string, ord int, start_time double, title string",
    "extracted": "meeting_id string, kind string, i int, text string, verbatim_quote string, turn_id string, inferred boolean, owner string, due string, done boolean",
    "claims": "meeting_id string, claim_ix int, claim string, verdict string, quote string, turn_id string, critical boolean",
    "gates": "meeting_id string, eval_ix int, gate string, fired boolean, reason string, decided_at timestamp",
    "batch_items": "meeting_id string, ord int, type string, start_time double, end_time double, content string, confidence double",
    "notes": "tenant_id string, note_id string, owner_sub string, title string, raw_text string, clean_text string, source string, created_at string, updated_at string, index_version int",
    "threads": "tenant_id string, owner_sub string, thread_id string, title string, messages array<struct<role:string,text:string,citations:array<string>,at:string>>, created_at string, updated_at string",
    "chunks": "key string, text string, type string, meeting_id string, note_id string, date_epoch long, owner_sub string, embed_version int, title string, chapter_title string, turn_start string, turn_end string",
    "vectors": "tenant_id string, index_version int, key string, type string, owner_sub string, date_epoch long, embedding array<float>",
    "indexed_keys": "tenant_id string, doc string, keys array<string>, index_version int",
    "overrides": "meeting_id string, title string, labels array<string>, segments map<string,struct<text:string,tags:array<string>,deleted:boolean>>, action_items_done map<string,boolean>",
    "segment_batches": "meeting_id string, seq long, segments array<struct<source:string,label:string,start_time:double,end_time:double,text:string>>",
}

#: What the recogniser writes: items of words and punctuation.
RECOGNISER_OUTPUT = (
    "results struct<items:array<struct<type:string,start_time:string,end_time:string,alternatives:array<struct<content:string,confidence:string>>>>>"
)


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])
