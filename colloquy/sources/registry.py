"""The registry of conversation stores as a small table, and its merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id | display name | format kind | store path templates.
HARNESSES = r"""
claude | Claude Code | jsonl | ${CLAUDE_CONFIG_DIR:-~/.claude}/projects/**/*.jsonl
codex | Codex CLI | jsonl-rollout | ${CODEX_HOME:-~/.codex}/sessions/**/rollout-*.jsonl, ${CODEX_HOME:-~/.codex}/sessions/**/rollout-*.jsonl.zst, ${CODEX_HOME:-~/.codex}/history.jsonl
gemini | Gemini CLI | json | ${GEMINI_CLI_HOME:-~}/.gemini/tmp/*/chats/**/*.json, ${GEMINI_CLI_HOME:-~}/.gemini/tmp/*/chats/**/*.jsonl
pi | pi | jsonl | ${DEJA_PI_ROOT:-~/.pi/agent/sessions}/**/*.jsonl
omp | omp | jsonl | ${DEJA_OMP_ROOT:-~/.omp/agent/sessions}/**/*.jsonl
prime | prime-agent | jsonl | ${DEJA_PRIME_ROOT:-~/.prime/agent/sessions}/**/*.jsonl
senpi | Senpi | jsonl | ${SENPI_CODING_AGENT_DIR:-~/.senpi/agent}/sessions/*/*.jsonl
kimchi | Kimchi Coding | jsonl | ${KIMCHI_CODING_AGENT_DIR:-~/.config/kimchi/harness}/sessions/*/*.jsonl
qwen | Qwen Code | jsonl | ${DEJA_QWEN_ROOT:-~/.qwen}/projects/*/chats/*.jsonl
zcode | ZCode | jsonl | ~/.zcode/projects/*/*.jsonl, ~/.zcode/cli/db/db.sqlite
commandcode | Command Code | jsonl | ~/.commandcode/projects/*/*.jsonl
cherrystudio | Cherry Studio | jsonl | <config>/CherryStudio/Data/Agents/.claude/projects/*/*.jsonl
antigravity | Antigravity | jsonl | ~/.gemini/antigravity*/brain/*/.system_generated/logs/transcript.jsonl
deepseek | DeepSeek Harness | jsonl | ${DSH_HOME:-~/.dsh}/sessions/*/session-*/session.jsonl, ${DSH_HOME:-~/.dsh}/sessions/*/session-*/session.jsonl.zstd
grok | Grok Build | jsonl | ${GROK_HOME:-~/.grok}/sessions/**/updates.jsonl, ${GROK_HOME:-~/.grok}/grok.db
kimi | Kimi Code | jsonl | ${KIMI_CODE_HOME:-~/.kimi-code}/sessions/*/*/agents/main/wire.jsonl
kiro | Kiro | jsonl | ~/.kiro/sessions/cli/*.jsonl, ~/.kiro/sessions/*/sess_*/messages.jsonl
copilot | Copilot CLI | jsonl | ${DEJA_COPILOT_ROOT:-~/.copilot/session-state}/*/events.jsonl
gjc | gajae-code | jsonl | ${GJC_CODING_AGENT_DIR:-~/.gjc/agent}/sessions/*/*.jsonl
amp | Amp | json-thread | ${XDG_DATA_HOME:-~/.local/share}/amp/threads/*.json
copilot-chat | VS Code Copilot Chat | vscode-storage | <vscode-User>/workspaceStorage/*/chatSessions/*.json, <vscode-User>/workspaceStorage/*/chatSessions/*.jsonl
cline | Cline | json | <vscode-User>/globalStorage/saoudrizwan.claude-dev/tasks/*/api_conversation_history.json
roo | Roo Code | json | <vscode-User>/globalStorage/rooveterinaryinc.roo-cline/tasks/*/api_conversation_history.json
kilocode | Kilo Code | json | <vscode-User>/globalStorage/kilocode.kilo-code/tasks/*/api_conversation_history.json
cursor | Cursor | sqlite-kv | <config>/Cursor/User/globalStorage/state.vscdb, <config>/Cursor/User/workspaceStorage/*/state.vscdb, ${CURSOR_CONFIG_DIR:-~/.cursor}/projects/**/agent-transcripts/**/*.jsonl
continue | Continue | json | ${CONTINUE_GLOBAL_DIR:-~/.continue}/sessions/*.json
zed | Zed | sqlite | <data>/zed/threads/threads.db
opencode | opencode | sqlite | ${XDG_DATA_HOME:-~/.local/share}/opencode/opencode.db
goose | Goose | jsonl | ${XDG_DATA_HOME:-~/.local/share}/goose/sessions/*.jsonl, ${XDG_DATA_HOME:-~/.local/share}/goose/sessions/sessions.db
crush | Crush | sqlite | <project>/.crush/crush.db
hermes | Hermes | sqlite | ~/.hermes/state.db, ~/.hermes/profiles/*/state.db
openclaw | OpenClaw | sqlite | ${OPENCLAW_STATE_DIR:-~/.openclaw}/agents/*/agent/openclaw-agent.sqlite
aider | aider | markdown | <project>/.aider.chat.history.md
chatgpt | ChatGPT | chatgpt-export | ${CHATGPT_EXPORT_DIR}/**/conversations.json, ${DEJA_CHATGPT_ROOT}/**/conversations.json
claude-web | Claude (web export) | claude-web-export | ${CLAUDE_EXPORT_DIR}/**/conversations.jsonl, ${DEJA_CLAUDE_WEB_ROOT}/**/conversations.jsonl
windsurf | Windsurf Cascade | detect-only | ~/.codeium/windsurf/cascade/*
"""


#: Id | more store path templates of a harness above, on Windows.
MORE_PATHS = r"""
cursor | %APPDATA%/Cursor/User/globalStorage/state.vscdb, %APPDATA%/Cursor/User/workspaceStorage/*/state.vscdb
goose | %APPDATA%/Block/goose/sessions/sessions.db, %APPDATA%/Block/goose/sessions/*.jsonl, %LOCALAPPDATA%/Block/goose/sessions/sessions.db, %APPDATA%/goose/sessions/sessions.db
windsurf | %APPDATA%/Windsurf/User/globalStorage/state.vscdb
"""


def rows() -> list[tuple[str, str, str, list[str]]]:
    listed = lambda paths: [p.strip() for p in paths.split(",")]
    more = {key: listed(paths) for key, paths in (line.split(" | ") for line in MORE_PATHS.strip().splitlines())}
    out = []
    for line in HARNESSES.strip().splitlines():
        key, name, kind, paths = (x.strip() for x in line.split(" | "))
        out.append((key, name, kind, listed(paths) + more.get(key, [])))
    return out


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "id string, display_name string, format_kind string, store_paths array<string>")


def merged(base: DataFrame, extra_paths: DataFrame, extra: DataFrame) -> DataFrame:
    """base with more paths (id, store_paths) for known ids, and the harnesses of extra that it lacks."""
    more = extra_paths.select("id", F.col("store_paths").alias("_more"))
    known = base.join(more, "id", "left").withColumn("store_paths", F.array_distinct(F.concat("store_paths", F.coalesce("_more", F.array().cast("array<string>"))))).drop("_more")
    return known.unionByName(extra.join(base.select("id"), "id", "left_anti"))


def discover(files: DataFrame, harnesses: DataFrame) -> DataFrame:
    """Stores, their number and bytes per harness, without parsing; every harness has a row."""
    held = files.groupBy(F.col("harness").alias("id")).agg(F.count("*").alias("stores"), F.sum("length").alias("bytes"))
    return harnesses.join(held, "id", "left").na.fill(0, ["stores", "bytes"]).select("id", "display_name", "stores", "bytes", (F.col("stores") > 0).alias("detected"))
