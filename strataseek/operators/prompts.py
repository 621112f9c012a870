"""What a generator is asked: instructions by language and feature, the question and its context."""

from __future__ import annotations

from strataseek.config import FEATURES
from strataseek.errors import ValidationError

#: Terms by language that an answer should use.
LANGUAGES = {"cobol": "paragraph, section, division, PERFORM, CALL, WORKING-STORAGE"}
# Fixed value: how the text of a feature that isn't known begins.
DEFAULT_FEATURE = "Default feature behavior"
#: What each feature asks for.
TASKS = {
    "code_explanation": "Say what the code does, why, and how its paragraphs work together.",
    "dependency_mapping": "List what the code performs, calls and copies, and what depends on it.",
    "pattern_detection": "Point out structures that occur more than once and how they differ.",
    "impact_analysis": "Say what else has to change, or may break, if the code changes.",
    "documentation_gen": "Write documentation: purpose, inputs, outputs, steps.",
    "translation_hints": "Suggest how each part would look in a modern language, and what has no counterpart.",
    "bug_pattern_search": "Look for likely faults and say under which conditions they show.",
    "business_logic": "State the business rules in plain words, with their conditions and amounts.",
}


def checked_language(language: str) -> str:
    own = language.strip().lower()
    if own not in LANGUAGES:
        raise ValidationError(f"unsupported language: {own} (known: {', '.join(sorted(LANGUAGES))})")
    return own


def system_prompt(feature: str = FEATURES[0], language: str = "cobol") -> str:
    """The same text for the same arguments. A blank feature is the first; one that isn't known is treated like the first, and the text says so."""
    language = checked_language(language)
    feature = feature.strip().lower() or FEATURES[0]
    known = feature in TASKS
    task = TASKS[feature] if known else f"{DEFAULT_FEATURE}: {TASKS[FEATURES[0]]}"
    return "\n".join(
        [
            "You explain legacy source code from the excerpts you are given, and from nothing else. Where they don't suffice, say so.",
            f"Language: {language.upper()}. Use its own terms where the excerpts show them: {LANGUAGES[language]}.",
            f"Task: {feature}. {task}",
            "Give a source for each statement as file:line, or as file:first-last for a range.",
            "End with 'Confidence: HIGH' if the excerpts show everything, 'Confidence: MEDIUM' if something had to be inferred, 'Confidence: LOW' otherwise.",
        ]
    )


def user_prompt(query: str, context: str) -> str:
    """context: of ``answers.context_block``."""
    if not query.strip():
        raise ValidationError("the query is blank")
    return f"Question: {query.strip()}\n\nExcerpts:\n\n{context}"
