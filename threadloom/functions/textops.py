"""Text cleaning, titles, redaction and estimates as column expressions.

White space, word boundaries and line ends follow ECMAScript, which Java's regular expressions define otherwise; the
constants below stand in for ``\\s`` and ``\\b``. Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ECMAScript white space and line terminators, as members of a character class.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The same as text.
WS_CHARS = "".join(map(chr, (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
_WORD = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

# Tags whose whole content is removed.
BLOCK_TAGS = (
    "permissions instructions",
    "collaboration_mode",
    "skills_instructions",
    "plugins_instructions",
    "apps_instructions",
    "environment_context",
    "local-command-caveat",
    "turn_aborted",
    "bash-input",
    "bash-stdout",
    "bash-stderr",
    "local-command-stdout",
    "command-name",
    "command-message",
    "command-args",
)
# Marks of tool output, page inspectors and other machine-written turns.
TOOL_MARKS = ("Chunk ID:", "Wall time:", "Process exited with code", "Original token count:", "tool_use_id", "tool_result", "toolCallId")
INSPECTOR_MARKS = ("Page URL:", "Target selector:", "Node position:", "Frame: top document")
SANDBOX_MARK = "Filesystem sandboxing defines which files can be read or written."
SKILL_MARKS = ("### Available skills", "## Skills")
DATE_MARKS = ("current_date", "workspace_roots")
KEPT_REPEATS = 3


def replace_all(text: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, by in pairs:
        text = F.regexp_replace(text, pattern, by)
    return text


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(WS_CHARS))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f" [{WS}]+|[{WS}&&[^ ]][{WS}]*", " "))  # single spaces are as they should be


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_tagged_blocks(text: Column) -> Column:
    text = replace_all(text, *((f"(?is)<{tag}>.*?</{tag}>", " ") for tag in BLOCK_TAGS))
    return replace_all(
        text,
        (r"(?is)\A(.*?)(?m:^)# AGENTS\.md instructions.*?</INSTRUCTIONS>", "$1 "),  # the first only
        (r"(?is)<INSTRUCTIONS>.*?</INSTRUCTIONS>", " "),
    )


def strip_codex_preamble(text: Column) -> Column:
    return replace_all(
        text,
        (r"(?i)# AGENTS\.md instructions for [^\n\r\u2028\u2029]*?(?=\n\n|\z)", " "),
        (rf"(?is)\A# In app browser:.*?## My request for Codex:[{WS}]*", ""),
        (rf"(?is)\AIn app browser:.*?My request for Codex:[{WS}]*", ""),
    )


def collapse_repeated_lines(text: Column) -> Column:
    """At most three consecutive equal lines stay."""
    return F.regexp_replace(text, r"(?md)^(.*)\n\1\n\1(?:\n\1)+$", "$1\n$1\n$1")


def normalize_whitespace(text: Column) -> Column:
    return trim(
        replace_all(text, (r"\r\n?", "\n"), (r"[\t\f\x0B]+", " "), (r"\n{3,}", "\n\n"), (r"[ \t]++(?=\n|\z)", ""))
    )


def clean_text(text: Column, provider: Column | None = None) -> Column:
    """Conversation text without escape codes, tagged blocks, provider preambles, tags and long runs of equal lines."""
    # texts without a ``<`` hold no block and no tag, and aren't searched for each kind of them
    text = let(F.regexp_replace(text, r"\x1B\[[0-9;]*m", ""), lambda t: F.when(t.contains("<"), strip_tagged_blocks(t)).otherwise(t))
    if provider is not None:  # the text so far is a value of its own there: two branches would compute it twice
        text = let(text, lambda t: F.when(provider == "codex", strip_codex_preamble(t)).otherwise(t))
    text = let(text, lambda t: F.when(t.contains("<"), F.regexp_replace(t, r"<[^>]+>", " ")).otherwise(t))
    return normalize_whitespace(collapse_repeated_lines(text))


def is_noise(cleaned: Column) -> Column:
    """Whether a cleaned text looks machine-written rather than said. The text is computed once, however it came about."""

    def any_of(marks: tuple[str, ...]) -> str:
        return "|".join(rf"\Q{m}\E" for m in marks)

    marks = f"(?i:{any_of(TOOL_MARKS + INSPECTOR_MARKS)})|{any_of((SANDBOX_MARK, *SKILL_MARKS))}"

    def looks_written(t: Column) -> Column:
        return (
            (F.length(t) == 0)
            | t.rlike(rf"(?s)\A[{WS}]*[\[{{].{{200,}}[\]}}][{WS}]*\z")
            | t.rlike(marks)
            | (t.contains(DATE_MARKS[0]) & t.contains(DATE_MARKS[1]))
            | ((F.length(t) > 1000) & t.rlike(r"(?m)^[A-Z0-9_]{3,}=.+$"))
        )

    return let(cleaned, looks_written)


def strip_for_title(text: Column) -> Column:
    return normalize_whitespace(
        replace_all(strip_tagged_blocks(text), (r"(?s)```.*?```", " "), ("`([^`]+)`", "$1"), ("[*_~>#-]+", " "))
    )


def synthesize_title(first_user_text: Column) -> Column:
    """A title from what the user said first: its first sentence, at most 80 characters; ``(untitled)`` without."""
    after = rf"(?!{_WORD})[:,{WS}-]*"
    title = trim(
        replace_all(
            strip_for_title(F.coalesce(first_user_text, F.lit(""))),
            (rf"(?i)\A(?:task|hey|hi|hello){after}", ""),
            (rf"(?i)\A(?:can you|could you|please|help me){after}", ""),
        )
    )
    # the sentence ends at the first mark; a mark at the very start ends nothing
    title = F.regexp_replace(title, rf"(?s)\A((?![.!?](?:[{WS}]|\z)).(?:(?![.!?](?:[{WS}]|\z)).)*[.!?])(?=[{WS}]|\z).*\z", "$1")
    title = F.regexp_replace(title, rf"(?s)\A(.{{77}})(?=.{{4,}}).*\z", "$1\u0000")
    title = F.regexp_replace(title, f"[{WS}]*\\x00\\z", "...")
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("(untitled)"))


def token_estimate(text: Column) -> Column:
    """About how many model tokens a text has: its words and marks, or a quarter of its characters."""
    words = F.regexp_count(text, F.lit(rf"[\p{{L}}\p{{N}}_-]+|[^{WS}]"))
    chars = F.length(trim(text)) / 4
    return F.when(chars == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.greatest(words.cast("double"), chars)))).cast("long")


# Before a word character, a boundary is the absence of another one. In the rules that begin with a literal the look-behind stands
# after it, so that the engine's search for the literal skips most texts.
_START = f"(?<!{_WORD})"

# What is redacted before a text leaves for an embedding service, in this order.
REDACTIONS = (
    (rf"ghp_(?<!{_WORD}ghp_)[A-Za-z0-9_]{{20,}}{BOUNDARY}", "<REDACTED_GITHUB_TOKEN>"),
    (rf"gho_(?<!{_WORD}gho_)[A-Za-z0-9_]{{20,}}{BOUNDARY}", "<REDACTED_GITHUB_TOKEN>"),
    (rf"github_pat_(?<!{_WORD}github_pat_)[A-Za-z0-9_]{{20,}}{BOUNDARY}", "<REDACTED_GITHUB_TOKEN>"),
    (rf"xox(?<!{_WORD}xox)[baprs]-[A-Za-z0-9-]{{20,}}{BOUNDARY}", "<REDACTED_SLACK_TOKEN>"),
    (rf"sk-(?<!{_WORD}sk-)[A-Za-z0-9_-]{{20,}}{BOUNDARY}", "<REDACTED_API_KEY>"),
    (rf"(?i){_START}(?:[A-Z0-9]+[_-])*(?:API[_-]?KEY|TOKEN)[{WS}]*[:=][{WS}]*['\"]?[^{WS}'\"]{{16,}}", "API_KEY=<REDACTED_API_KEY>"),
    (rf"(?i){_START}(authorization[{WS}]*:[{WS}]*bearer[{WS}]+)[A-Za-z0-9._~+/-]+=*", "$1<REDACTED_BEARER_TOKEN>"),
    (
        rf"(?i){_START}(password|secret|token|api[_-]?key)[{WS}]*[:=][{WS}]*['\"]?(?!<REDACTED_)[^{WS}'\"]{{12,}}",
        "$1=<REDACTED_SECRET>",
    ),
    (rf"(?=[A-Za-z0-9+/]{{48}}){BOUNDARY}[A-Za-z0-9+/]{{48,}}={{0,2}}{BOUNDARY}", "<REDACTED_HIGH_ENTROPY_STRING>"),
)


def redacted(text: Column) -> Column:
    return replace_all(text, *REDACTIONS)


def with_redaction(df: DataFrame, text_col: str, out: str = "redacted", count: str = "redactions") -> DataFrame:
    """``df`` with the redacted text and how many matches each rule found, in sum, in the text it met."""
    df = df.withColumns({out: F.col(text_col), count: F.lit(0).cast("long")})
    for pattern, by in REDACTIONS:  # most texts hold nothing, and are not searched again to replace it
        df = df.withColumn("__n", F.regexp_count(out, F.lit(pattern)))
        df = df.withColumns(
            {out: F.when(F.col("__n") > 0, F.regexp_replace(out, pattern, by)).otherwise(F.col(out)), count: F.col(count) + F.col("__n")}
        )
    return df.drop("__n")


def embedding_text(text: Column, input_type: str, model: str) -> Column:
    """The text with the prefix that a family of embedding models expects."""
    lower = model.lower()
    if "embed" in lower and "qwen" in lower:
        return F.concat(F.lit("Instruct: Retrieve relevant documents for the given query\nQuery: "), text) if input_type == "query" else text
    if "embeddinggemma" in lower or "nomic" in lower:
        return F.concat(F.lit("task: search result | query: " if input_type == "query" else "title: none | text: "), text)
    return text


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def resume_command(provider: Column, native_id: Column, cwd: Column, pi_session_id: bool = False) -> Column:
    start = F.concat(F.lit("cd "), shell_quote(cwd), F.lit(" && "))
    pi = "pi --session-id " if pi_session_id else "pi --session "
    tool = F.when(provider == "claude", "claude --resume ").when(provider == "codex", "codex resume ").when(provider == "pi", pi)
    return F.concat(start, tool, shell_quote(native_id))


def fork_command(provider: Column, native_id: Column, cwd: Column) -> Column:
    """Null where a provider can't fork a session."""
    start = F.concat(F.lit("cd "), shell_quote(cwd), F.lit(" && "))
    return F.concat(start, F.when(provider == "codex", "codex fork ").when(provider == "pi", "pi --fork "), shell_quote(native_id))
