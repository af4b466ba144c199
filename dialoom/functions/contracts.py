"""The contracts of the documents that the engine writes, as JSON Schemas."""

from __future__ import annotations

TEXT, FLAG, NUMBER, ANY = {"type": "string"}, {"type": "boolean"}, {"type": "number", "minimum": 0}, {"type": "object"}
COUNT, SURE, SCORE = {"type": "integer", "minimum": 0}, {"type": "number", "minimum": 0, "maximum": 1}, {"type": ["integer", "null"], "minimum": 1, "maximum": 5}
TEXT_OR_NULL = {"type": ["string", "null"]}


def array(items: dict, unique: bool = False) -> dict:
    return {"type": "array", "items": items} | ({"uniqueItems": True} if unique else {})


def record(required: dict[str, dict], optional: dict[str, dict] | None = None, open_: bool = True) -> dict:
    return {"type": "object", "required": list(required), "properties": required | (optional or {}), "additionalProperties": open_}


# The enumerations and field names of both contracts.
ROLE = {"enum": ["interviewer", "candidate", "unknown"]}
PHASE = {"enum": ["INTRO", "PROJECT", "TECH_QA", "CODING", "CODING_DISCUSSION", "BEHAVIORAL", "CANDIDATE_QUESTIONS", "END", "UNKNOWN"]}
EVENT = {"enum": ["coding_silence", "coding_low_speech_density", "coding_noise"]}
NODE = {"enum": ["main_question", "follow_up", "clarification"]}
RELATION = {"enum": ["first_question", "same_topic", "topic_switch"]}
STATUS = {"enum": ["evaluated", "not_evaluated"]}
COUNTED = ("raw_segment_count", "valid_segment_count", "invalid_segment_count", "v1_qa_count", "qa_count", "question_count", "main_question_count", "follow_up_count", "clarification_count", "coding_event_count", "unknown_role_count", "role_correction_count")
ALSO_COUNTED = ("topic_switch_count", "coding_silence_event_count", "valid_unknown_role_count")

IDS = array(TEXT, unique=True)
TEXTS = array(TEXT)
SPAN = {"start": NUMBER, "end": NUMBER, "segment_ids": IDS}
CLEANUP = record({"valid": FLAG, "reasons": TEXTS, "duration_seconds": NUMBER, "meaningful_char_count": COUNT, "text_density": NUMBER, "question_strength": NUMBER})
SEGMENT = record({"id": TEXT, "start": NUMBER, "end": NUMBER, "speaker_id": TEXT, "role": ROLE, "role_confidence": SURE, "phase": PHASE, "text": TEXT, "cleanup": CLEANUP}, {"speaker": TEXT})
ANSWER = record({"role": ROLE, "role_confidence": SURE, **SPAN, "speaker_ids": IDS, "text": TEXT})
QUESTION = record(
    {"id": TEXT, "node_type": NODE, "relation_to_previous": RELATION, "asked_by": ROLE, "role_confidence": SURE, "phase": PHASE, **SPAN, "speaker_ids": IDS, "text": TEXT, "answers": array(ANSWER), "children": array({"$ref": "#/$defs/question"})},
    {"topic": ANY},
)
STRUCTURE = record({"version": {"const": "V2"}, "method": TEXT, "speaker_diarization_is_weak_evidence": {"const": True}, "valid_roles": array(ROLE), "valid_phases": array(PHASE)})
SPEAKER = record({"id": TEXT, "dominant_role": ROLE, "role_confidence": SURE}, {"role_counts": ANY})
CONVERSATION = record(
    {
        "schema_version": {"const": "0.2.0"}, "conversation_structure": STRUCTURE, "segments": array(SEGMENT), "phase_spans": array(record({"phase": PHASE, **SPAN})),
        "events": array(record({"id": TEXT, "event_type": EVENT, "phase": PHASE, **SPAN, "duration_seconds": NUMBER}, {"reasons": TEXTS})),
        "question_tree": array({"$ref": "#/$defs/question"}), "statistics": record(dict.fromkeys(COUNTED, COUNT), dict.fromkeys(ALSO_COUNTED, COUNT) | {"cleanup_reason_counts": ANY}),
    },
    {"created_at": TEXT, "source_audio": TEXT_OR_NULL, "audio": {"type": ["object", "null"]}, "speakers": array(SPEAKER), "turns": array(ANY), "qa_pairs": array(ANY)},
) | {"$defs": {"question": QUESTION}}


def closed(**fields: dict) -> dict:
    return record(fields, open_=False)


OVERVIEW = closed(assessment_status=STATUS, summary=TEXT, strengths=TEXTS, risks=TEXTS, suggested_focus=TEXTS)
ASSESSED = closed(
    question_id=TEXT, assessment_status=STATUS, summary=TEXT, scores=closed(relevance=SCORE, technical_depth=SCORE, clarity=SCORE, structure=SCORE), strengths=TEXTS, risks=TEXTS, suggestions=TEXTS,
    improved_answer=TEXT_OR_NULL, evidence_segment_ids=IDS,
)
ANALYSIS = closed(
    schema_version={"const": "0.1.0"}, created_at=TEXT, source=closed(conversation_schema_version={"const": "0.2.0"}, question_count=COUNT, request_count={"type": "integer", "minimum": 1}),
    provider=closed(name={"type": "string", "minLength": 1}, model=TEXT_OR_NULL, remote=FLAG, endpoint=TEXT_OR_NULL),
    privacy=closed(remote_consent=FLAG, redaction_enabled=FLAG, redaction_counts={"type": "object", "additionalProperties": COUNT}, sent_audio={"const": False}, sent_full_transcript={"const": False}, payload_scope={"const": "question_tree_only"}, request_sha256={"type": "string", "pattern": "^[a-f0-9]{64}$"}),
    overview=OVERVIEW, questions=array(ASSESSED), review_plan=array(closed(priority=TEXT, topic=TEXT, action=TEXT, question_ids=IDS)), warnings=TEXTS,
)
