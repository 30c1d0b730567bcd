"""Schemas of the documents and tables that are read and written."""

UTTERANCE = "utterance_id STRING, start_sec DOUBLE, end_sec DOUBLE, speaker_id STRING, text STRING"
TRANSCRIPT = f"video_id STRING, asr_model STRING, language STRING, utterances ARRAY<STRUCT<{UTTERANCE.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE')}>>"
CASES = "cases ARRAY<STRUCT<case_id: STRING, start_sec: DOUBLE, end_sec: DOUBLE>>"
SLIDES = "video_id STRING, slides ARRAY<STRUCT<slide_id: STRING, case_id: STRING, start_sec: DOUBLE, end_sec: DOUBLE, frame_path: STRING, caption: STRING>>"
QA_PAIR = "type: STRING, question: STRING, answer: STRING, quote: STRING, utterance_id: STRING, speaker_role: STRING"
TASK = f"case_summary STRING, slides STRING, slide_paths ARRAY<STRING>, qa_pairs ARRAY<STRUCT<{QA_PAIR}>>, conclusion STRUCT<text: STRING, quote: STRING>"
SHAREGPT = "id STRING, conversations ARRAY<STRUCT<from: STRING, value: STRING>>, images ARRAY<STRING>, metadata STRING"
JUDGE_OUTPUT = "custom_id STRING, response STRUCT<status_code: INT, request_id: STRING, body: STRUCT<output: ARRAY<STRUCT<type: STRING, content: ARRAY<STRUCT<type: STRING, text: STRING>>>>>>, error STRUCT<type: STRING, status_code: INT, message: STRING>"
