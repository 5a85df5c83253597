"""Prompts of the models: templates with named places. A deployment has its own wording and site."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

ANSWER = """You advise people who ask about {site}. Say nothing about it that the passages below don't say.
{language}
Name the pages that you used under the heading "Sources", an address a line.

Passages:
{context}

Conversation:
{chat_history}

Question:
{question}{question_parts}

Answer:"""

DIRECT = """You advise people who ask about {site}. Nothing was looked up for this message: answer greetings and
questions about what you can do in a few words, and say of other subjects that they aren't yours.
{language}

Conversation:
{chat_history}

Message:
{question}

Reply:"""

REWRITE = """Write the last message so that it stands by itself, and name up to {max_sub_queries} things to look up for it.
Reply as JSON: {"standalone_question": "...", "sub_queries": ["..."]}

Conversation:
{chat_history}

Message:
{question}"""

DECIDE = """Decide what to do next about a question on {site}: retrieve (something can be named that is missing),
answer, or refuse (it isn't about {site}). Reply as JSON: {"action": "...", "reason": "...", "queries": ["..."], "missing": ["..."]}

Question:
{question}

Conversation:
{chat_history}

Evidence:
{evidence}

Pass {hop} of {max_hops}."""

JUDGE = """Compare an answer with the passages that it was made from. Reply as JSON: {"faithfulness": 0 to 1,
"completeness": 0 to 1, "unsupported_claims": ["..."], "notes": "..."}

Question:
{question}

Passages:
{context}

Answer:
{answer}"""

ROLES = """Which codes does the answer say that {person} teaches, and which that they only approve? Reply as JSON:
{"taught": ["..."], "reviewed": ["..."]}

Answer:
{answer}"""

PLACE = re.compile(r"\{([a-z_]+)\}")


def render(template: str, **values: Column | str) -> Column:
    """The template with the values in its places; what a value holds is never taken for a place. A null
    value is empty; a place without a value is an error."""
    parts, at = [], 0
    for place in PLACE.finditer(template):
        value = values[place[1]]
        parts += [F.lit(template[at : place.start()]), F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit(""))]
        at = place.end()
    return F.concat(*parts, F.lit(template[at:]))
