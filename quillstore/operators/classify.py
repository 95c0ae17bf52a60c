"""Which way to answer a question: by what was observed about people and times, by retrieval, or both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 10_000  # characters of a question that are looked at

# Patterns of each family, and the kind of question a family stands for.
FAMILIES = {
    "temporal": (
        r"\bwhen\s+did\b", r"\bhow\s+long\s+(?:ago|since|has)\b", r"\bbefore\s+or\s+after\b", r"\bfirst\s+(?:time|mention)\b", r"\blast\s+(?:time|mention)\b",
        r"\bwhat\s+(?:month|year|date|day)\b", r"\bchronolog", r"\btimeline\b", r"\bsequence\s+of\b", r"\bhistory\s+of\b", r"\bover\s+time\b", r"\brecently\b",
        r"\bearlier\s+(?:this|last)\b", r"\bchanged?\s+(?:from|since|over)\b", r"\bused\s+to\b",
        r"\b(?:do|does|did|am|is|are|was|were)\s+(?:I|you|we|he|she|they|the\s+user)\s+still\b",
    ),
    "personal": (
        r"\b(?:my|the\s+user(?:'s)?)\s+(?:name|job|work|company|family|wife|husband|partner|child|kid|pet|dog|cat)\b",
        r"\bwhere\s+(?:do\s+I|does\s+(?:the\s+user|he|she))\s+(?:live|work|study)\b", r"\bwhat\s+(?:do\s+I|does\s+(?:the\s+user|he|she))\s+do\b",
        r"\bwho\s+(?:is|am)\b", r"\bhow\s+old\b", r"\b(?:user|my)\s+(?:age|birthday|birth\s*date)\b", r"\b(?:allergic|allergy|allergies|health\s+condition)\b",
        r"\b(?:education|(?:went|go)\s+to\s+(?:school|university|college))\b", r"\b(?:married|engaged|relationship)\b",
    ),
    "preference": (
        r"\b(?:favorite|favourite|preferred|prefer)\b", r"\bwhat\s+(?:do\s+I|does\s+(?:the\s+user|he|she))\s+(?:like|enjoy|prefer|love)\b",
        r"\b(?:like|enjoy|prefer|love)\s+(?:to\s+)?(?:eat|drink|watch|read|listen|play|use|cook|travel)\b", r"\bgo-to\b",
        r"\busually\s+(?:eat|drink|order|choose|pick|use)\b", r"\b(?:hobby|hobbies|interest|interests)\b", r"\bmusic\s+taste\b", r"\bfood\s+(?:preference|choice)\b",
    ),
    "multi-session": (
        r"\bhave\s+(?:I|we)\s+(?:ever|before)\s+(?:discussed|talked|mentioned)\b", r"\bprevious\s+(?:conversation|session|chat|discussion)\b",
        r"\blast\s+(?:conversation|session|chat|time\s+we\s+(?:talked|chatted|spoke))\b", r"\bdo\s+you\s+remember\b",
        r"\bwe\s+(?:talked|discussed|mentioned)\s+(?:about|before)\b", r"\bacross\s+(?:our\s+)?conversations\b", r"\bin\s+(?:a\s+)?(?:previous|earlier|past)\b",
    ),
    "assistant": (
        r"\bwhat\s+did\s+(?:you|the\s+assistant)\s+(?:say|suggest|recommend|advise|explain)\b",
        r"\b(?:the\s+assistant|you)\s+(?:said|mentioned|explained|suggested|recommended|told\s+me|advised)\b", r"\byou\s+told\s+me\b",
        r"\byou\s+(?:said|mentioned)\s+(?:that|to|I\s+should)\b", r"\byour\s+(?:suggestion|recommendation|advice)\b",
        r"\bwhat\s+(?:you|the\s+assistant)\s+(?:suggested|recommended)\b", r"\bdid\s+you\s+(?:suggest|recommend|advise|mention)\b",
        r"\bthe\s+advice\s+you\s+gave\b", r"\b(?:in\s+(?:our|the)\s+conversation)\s*,?\s*you\b",
    ),
    "retrieval": (
        r"\bhow\s+(?:to|do\s+(?:I|you))\b", r"\bwhat\s+(?:is|are)\s+(?:the\s+)?(?:command|syntax|api|endpoint|url|port|password|config)\b",
        r"\bcode\s+(?:for|to|that)\b", r"\bstep(?:s|\-by\-step)\b", r"\bexplain\s+(?:how|what|the)\b", r"\bspecific\s+(?:detail|instruction|recommendation)\b",
        r"\bexact\s+(?:words|quote|response)\b", r"\baccording\s+to\b",
    ),
}
KINDS = {
    "temporal": "temporal-reasoning", "personal": "single-session-user", "assistant": "single-session-assistant",
    "preference": "single-session-preference", "multi-session": "multi-session",
}


def scores(text: str) -> dict[str, Column]:
    """How many patterns of each family a question has."""
    flat = F.regexp_replace(F.substring(text, 1, MOST), r"\s+", " ")
    return {k: sum((flat.rlike(f"(?i){p}").cast("int") for p in family), F.lit(0)) for k, family in FAMILIES.items()}


def route(observed: Column, retrieval: Column) -> Column:
    return F.when(retrieval > observed, "retrieval").when(observed > retrieval, "observer").otherwise("hybrid")


def confidence(observed: Column, retrieval: Column) -> Column:
    sure = F.when(retrieval > observed, F.least(F.lit(0.9), 0.4 + retrieval * 0.15)).when(observed > retrieval, F.least(F.lit(0.9), 0.5 + observed * 0.1))
    return F.coalesce(sure, F.when(observed == 0, 0.3).otherwise(0.4))


def kind(observed: Column, retrieval: Column, each: dict[str, Column]) -> Column:
    """The observer family with the most patterns, of those that tie the first by name; null for hybrid questions."""
    best = F.greatest(*[each[k] for k in KINDS])
    out = F.lit(None).cast("string")
    for k, name in sorted(KINDS.items(), key=lambda x: x[1], reverse=True):
        out = F.when(each[k] == best, name).otherwise(out)
    return F.when(retrieval > observed, "knowledge-update").when(observed > retrieval, out)
