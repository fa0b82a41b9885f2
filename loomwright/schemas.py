"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

ATTEMPT_LOG = "task_id string, fix_mode_attempt_count int, status string"
LIBRARY_LOG = "problem_id string, library string, fix_mode_attempt_count int, status string"
TASK = "task_id string, prompt string, entry_point string, test string"
LIBRARY_TASK = "metadata struct<problem_id:string,library:string>"
PROCESS_RESULT = "returncode int, stdout string, stderr string"
MESSAGE = "struct<role:string,content:string>"
TUNING_PAIR = "Question string, Answer string"
PULL_PROGRESS = "model string, status string, completed long, total long, at timestamp"
