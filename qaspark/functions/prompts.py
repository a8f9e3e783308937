"""Prompt rendering, chat messages and answer extraction (F7-F12) as Column
expressions.

Template fill is literal replacement; ``{context}`` is filled before
``{question}`` (so a ``{question}`` inside a context is filled too); without
contexts ``{context}`` stays verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS, strip_ws

# ---- fixed values ----------------------------------------------------------
DEFAULT_TEMPLATE_WITH_CONTEXT = "Context: {context}\n\nQuestion: {question}\nAnswer:"
DEFAULT_TEMPLATE_NO_CONTEXT = "Question: {question}\nAnswer:"
CHAT_MODEL_MARKER = "qwen3"          # model path substring (lower-cased) that selects chat messages
CHAT_ASSISTANT_START = "<|im_start|>assistant"
CHAT_END_PATTERN = r"(?s)<\|im_end\|>.*$"
ANSWER_MARKER = "Answer:"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def _has_items(arr: Column) -> Column:
    return F.coalesce(F.size(arr) > 0, F.lit(False))


def _truthy(s: Column) -> Column:
    return s.isNotNull() & (s != "")


def context_text(contexts) -> Column:
    return F.array_join(_c(contexts), "\n")


def fill_template(template, question, contexts=None) -> Column:
    """``template`` with ``{context}`` then ``{question}`` replaced."""
    t, q = _c(template), _c(question)
    no_ctx = F.replace(t, F.lit("{question}"), q)
    if contexts is None:
        return no_ctx
    ctx = _c(contexts)
    with_ctx = F.replace(F.replace(t, F.lit("{context}"), context_text(ctx)), F.lit("{question}"), q)
    return F.when(_has_items(ctx), with_ctx).otherwise(no_ctx)


def render_prompt(question, contexts=None, template=None, system_prompt=None) -> Column:
    """The full text prompt for a non-chat model.

    Uses ``template`` when it is non-empty, else the default prompt (with a
    ``Context:`` block when contexts exist); a non-empty system prompt is put
    in front, separated by a blank line.
    """
    q = _c(question)
    ctx = _c(contexts) if contexts is not None else F.lit(None).cast("array<string>")
    default = F.when(
        _has_items(ctx),
        F.concat(F.lit("Context: "), context_text(ctx), F.lit("\n\nQuestion: "), q, F.lit("\nAnswer:")),
    ).otherwise(F.concat(F.lit("Question: "), q, F.lit("\nAnswer:")))
    if template is not None:
        t = _c(template)
        body = F.when(_truthy(t), fill_template(t, q, ctx)).otherwise(default)
    else:
        body = default
    if system_prompt is None:
        return body
    s = _c(system_prompt)
    return F.when(_truthy(s), F.concat(s, F.lit("\n\n"), body)).otherwise(body)


def is_chat_model(model_path) -> Column:
    """F11 predicate: chat messages are used when the path names the marker."""
    return F.lower(_c(model_path)).contains(CHAT_MODEL_MARKER)


def chat_messages(question, contexts=None, template=None, system_prompt=None) -> Column:
    """``array<struct<role, content>>`` -- optional system message (the
    system prompt, else ``Context: …`` when contexts exist), then the user
    message (template-filled when a template is given, else the question)."""
    q = _c(question)
    ctx = _c(contexts) if contexts is not None else F.lit(None).cast("array<string>")
    sys_content = F.when(_has_items(ctx), F.concat(F.lit("Context: "), context_text(ctx)))
    if system_prompt is not None:
        s = _c(system_prompt)
        sys_content = F.when(_truthy(s), s).otherwise(sys_content)
    if template is not None:
        t = _c(template)
        user = F.when(_truthy(t), fill_template(t, q, ctx)).otherwise(q)
    else:
        user = q
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), sys_content.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    return F.filter(msgs, lambda m: m["content"].isNotNull())


def answer_after_marker(text) -> Column:
    """Text after the last ``Answer:`` (stripped)."""
    return strip_ws(F.substring_index(_c(text), ANSWER_MARKER, -1))


def answer_after_prompt(text, prompt) -> Column:
    """Text after the prompt's length (stripped)."""
    t = _c(text)
    return strip_ws(t.substr(F.length(_c(prompt)) + 1, F.length(t) + 1))


def answer_from_chat(text) -> Column:
    """After the last assistant start marker, cut at the end marker; else
    split on ``assistant\\s*:?\\s*`` (any case) and take the last part."""
    t = _c(text)
    after_marker = strip_ws(F.regexp_replace(
        strip_ws(F.substring_index(t, CHAT_ASSISTANT_START, -1)), F.lit(CHAT_END_PATTERN), F.lit("")))
    parts = F.split(t, F.lit(r"(?i)assistant" + WS_CLASS + "*:?" + WS_CLASS + "*"))
    after_split = F.when(F.size(parts) > 1, strip_ws(F.element_at(parts, -1))).otherwise(F.lit(""))
    return (F.when(t.contains(CHAT_ASSISTANT_START), after_marker)
             .when(F.lower(t).contains("assistant"), after_split)
             .otherwise(F.lit("")))


def extract_answer(text, prompt=None, chat=None) -> Column:
    """F12 fallback chain used when token-level extraction yields nothing."""
    t = _c(text)
    plain = F.when(t.contains(ANSWER_MARKER), answer_after_marker(t))
    plain = plain.otherwise(answer_after_prompt(t, prompt) if prompt is not None else strip_ws(t))
    if chat is None:
        return plain
    return F.when(_c(chat), answer_from_chat(t)).otherwise(plain)
