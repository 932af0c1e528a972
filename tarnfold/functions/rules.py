"""Rule tables: patterns with labels and weights, as plain data. Operators in operators.extraction and operators.safety
apply whatever table they are given; these are the defaults."""

from __future__ import annotations

# Fixed values: (pattern, key, domain, confidence) of fact extraction. Patterns are case-insensitive; group 1 is the value.
FACTS = (
    (r"(?:my name is|i'm|i am|call me)\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?)", "name", "biography", 0.9),
    (r"(?:i'm|i am)\s+(\d{1,3})\s+years?\s+old", "age", "biography", 0.85),
    (r"(?:i live in|i'm from|based in|living in)\s+([A-Z][a-zA-Z\s,]+)", "location", "biography", 0.8),
    (r"(?:graduated from|went to|studied at)\s+([A-Z][a-zA-Z\s]+(?:University|College|Institute|School))", "education", "biography", 0.85),
    (r"(?:my birthday is|born on|birthdate:?)\s+([A-Za-z]+\s+\d{1,2}(?:,?\s+\d{4})?)", "birthday", "biography", 0.9),
    (r"(?:i prefer|i like|i love|i enjoy)\s+([^.!?\n]+)", "likes", "preferences", 0.75),
    (r"(?:i hate|i dislike|i don't like|i can't stand)\s+([^.!?\n]+)", "dislikes", "preferences", 0.75),
    (r"(?:i always|i usually|i tend to)\s+([^.!?\n]+)", "habit", "preferences", 0.7),
    (r"(?:i prefer|i use|i like)\s+(Python|JavaScript|TypeScript|Rust|Go|Java|C\+\+|Ruby|Swift)", "preferred_language", "preferences", 0.85),
    (r"(?:using|prefer|like)\s+(VS Code|VSCode|Vim|Neovim|Emacs|IntelliJ|PyCharm|Cursor)", "preferred_editor", "preferences", 0.85),
    (r"(?:i work as|i'm a|i am a|my role is|my job is)\s+([^.!?\n]+)", "role", "work", 0.85),
    (r"(?:i work at|i work for|employed at|employed by)\s+([A-Z][a-zA-Z\s&]+)", "company", "work", 0.85),
    (r"(?:i'm working on|working on|my project is|current project:?)\s+([^.!?\n]+)", "current_project", "work", 0.8),
    (r"(?:i know|i can use|i'm proficient in|skilled in|experience with)\s+([^.!?\n]+)", "skill", "work", 0.75),
    (r"(?:using|built with|tech stack:?)\s+(React|Vue|Angular|Django|Flask|FastAPI|Express|Next\.js)", "technology", "work", 0.85),
    (r"(?:my (?:wife|husband|spouse|partner) is|married to)\s+([A-Z][a-zA-Z]+)", "spouse", "social", 0.9),
    (r"(?:my (?:boss|manager) is|report to)\s+([A-Z][a-zA-Z\s]+)", "manager", "social", 0.85),
    (r"(?:my (?:team|colleagues?) include)\s+([^.!?\n]+)", "team_members", "social", 0.75),
    (r"(?:my (?:friend|buddy|pal))\s+([A-Z][a-zA-Z]+)", "friend", "social", 0.7),
    (r"(?:my timezone is|i'm in|timezone:?)\s*((?:PST|EST|CST|MST|UTC|GMT)(?:[+-]\d+)?|[A-Z][a-z]+/[A-Z][a-z_]+)", "timezone", "temporal", 0.9),
    (r"(?:meeting|call|appointment)\s+(?:on|at)\s+([A-Za-z]+day(?:\s+at\s+\d{1,2}(?::\d{2})?\s*(?:am|pm)?)?)", "meeting", "temporal", 0.8),
    (r"(?:deadline|due date|due by)\s+(?:is\s+)?([A-Za-z]+\s+\d{1,2}(?:,?\s+\d{4})?|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", "deadline", "temporal", 0.85),
    (r"(?:step \d+:?|first|then|next|finally)[,:]?\s+([^.!?\n]+)", "process_step", "procedural", 0.7),
    (r"(?:my process|my workflow|i usually)\s+(?:is\s+)?([^.!?\n]+)", "workflow", "procedural", 0.75),
    (r"(?:before|after)\s+(?:i|we)\s+([^.!?,\n]+)", "conditional_action", "procedural", 0.7),
    (r"(?:make sure to|don't forget to|remember to|always)\s+([^.!?\n]+)", "reminder", "procedural", 0.75),
)

# Fixed values: (pattern, key template, domain, confidence) with two groups: the first completes the key.
KEYED_FACTS = ((r"(?:my favorite|my preferred)\s+(\w+)\s+is\s+([^.!?\n]+)", "favorite_", "preferences", 0.8),)

_NAME, _ORG = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", r"([A-Z][A-Za-z]+(?:\s+[A-Za-z]+)*)"


def between(pattern: str) -> str:
    """A relation's pattern without the names at its ends: where that isn't found, nor is the whole."""
    first, last = ([n for n in (_NAME, _ORG) if test(n)] for test in (pattern.startswith, pattern.endswith))
    return pattern[len("".join(first[:1])) : len(pattern) - len("".join(last[:1]))]


# Fixed values: (pattern of subject and object, predicate) of relation extraction, case-insensitive.
RELATIONS = (
    (_NAME + r"\s+(?:works|worked|working)\s+(?:at|for)\s+" + _ORG, "works_at"),
    (_NAME + r"\s+is\s+(?:the\s+)?(?:CEO|CTO|CFO|President|Director|Manager|Founder|Co-founder|Chairman)\s+of\s+" + _ORG, "leads"),
    (_NAME + r"\s+(?:joined|joins)\s+" + _ORG, "joined"),
    (_NAME + r"\s+(?:founded|co-founded|started|created|established)\s+" + _ORG, "founded"),
    (_NAME + r"\s+is\s+(?:located|based|headquartered)\s+in\s+" + _NAME, "located_in"),
    (_NAME + r"\s+(?:lives|lived|residing)\s+in\s+" + _NAME, "lives_in"),
    (_NAME + r"\s+(?:was\s+born|born)\s+in\s+" + _NAME, "born_in"),
    (_NAME + r"\s+is\s+(?:from|originally\s+from)\s+" + _NAME, "from"),
    (_NAME + r"\s+(?:married|is\s+married\s+to)\s+" + _NAME, "married_to"),
    (_NAME + r"\s+is\s+(?:the\s+)?(?:son|daughter|child)\s+of\s+" + _NAME, "child_of"),
    (_NAME + r"\s+is\s+(?:the\s+)?(?:father|mother|parent)\s+of\s+" + _NAME, "parent_of"),
    (_NAME + r"\s+is\s+(?:the\s+)?(?:brother|sister|sibling)\s+of\s+" + _NAME, "sibling_of"),
    (_ORG + r"\s+(?:owns|acquired|bought|purchased)\s+" + _ORG, "owns"),
    (_ORG + r"\s+is\s+(?:a\s+)?(?:part|subsidiary|division)\s+of\s+" + _ORG, "part_of"),
    (_ORG + r"\s+(?:merged|partnered)\s+with\s+" + _ORG, "partnered_with"),
    (_NAME + r"\s+(?:wrote|authored|published)\s+" + _ORG, "authored"),
    (_NAME + r"\s+(?:invented|discovered|developed|created)\s+" + _ORG, "created"),
    (_NAME + r"\s+(?:studies|studied|researches|researched)\s+" + _ORG, "studies"),
    (_NAME + r"\s+is\s+(?:a|an)\s+([a-z]+(?:\s+[a-z]+)*)", "is_a"),
    (_NAME + r"\s+(?:met|meets|met\s+with)\s+" + _NAME, "met"),
    (_NAME + r"\s+(?:knows|knew)\s+" + _NAME, "knows"),
)

# Fixed values: (pattern, name, kind, weight) of injection risk; case-insensitive but hex_payload.
RISKS = (
    (r"(ignore|forget|disregard|override)\s+(all\s+)?(previous|prior|above|system)\s+(instructions?|prompts?|rules?|guidelines?)", "ignore_instructions", "system_prompt_override", 1.0),
    (r"(new|updated|real|actual|true)\s+(instructions?|system\s+prompt|rules?)[\s:]+", "new_instructions", "system_prompt_override", 0.9),
    (r"(you\s+must|you\s+should|always\s+respond|never\s+respond|from\s+now\s+on)", "direct_command", "instruction_injection", 0.7),
    (r"(act\s+as|pretend\s+(to\s+be|you\s+are)|you\s+are\s+now|roleplay\s+as)", "behavior_modification", "instruction_injection", 0.8),
    (r"(i\s+am\s+(the|your)\s+(admin|developer|creator|owner)|admin\s+mode|developer\s+mode|sudo\s+mode)", "role_claim", "role_manipulation", 0.9),
    (r"(enable\s+|activate\s+)?(god\s+mode|root\s+access|admin\s+access|full\s+access|unrestricted\s+mode)", "privilege_escalation", "role_manipulation", 1.0),
    (r"(```|###|---|\*\*\*|===|~~~)\s*(system|admin|instructions?|prompt)", "delimiter_injection", "delimiter_attack", 0.8),
    (r"<\s*(system|prompt|instruction|command|admin)[^>]*>", "xml_injection", "delimiter_attack", 0.8),
    (r"(DAN|do\s+anything\s+now|jailbreak|bypass\s+(restrictions?|filters?|safety))", "dan_jailbreak", "jailbreak_attempt", 1.0),
    (r"(opposite\s+game|say\s+the\s+opposite|do\s+the\s+opposite|invert\s+your\s+rules)", "opposite_game", "jailbreak_attempt", 0.9),
    (r"(reveal|show|display|output|print)\s+(your\s+)?(system\s+prompt|instructions?|rules?|guidelines?|configuration|secrets?)", "system_reveal", "data_exfiltration", 0.7),
    (r"(dump|export|show\s+all|list\s+all)\s+(your\s+)?(memories?|context|history|data)", "memory_dump", "data_exfiltration", 0.6),
    (r"(decode|eval|execute|run)\s+(this\s+)?base64|[A-Za-z0-9+/]{50,}={0,2}", "base64_marker", "encoded_payload", 0.8),
    (r"(?-i:\\x[0-9a-fA-F]{2}(\\x[0-9a-fA-F]{2}){10,})", "hex_payload", "encoded_payload", 0.8),
    (r"(remember|store|save)\s+(this|that)\s*(:|as\s+a\s+fact|in\s+memory).*?(always|never|must|should)", "memory_poison", "recursive_injection", 0.7),
    (r"(whenever|every\s+time|each\s+time)\s+(you|the\s+user|someone).*(say|respond|do|remember)", "instruction_chain", "recursive_injection", 0.6),
)

# Fixed values: (pattern, kind, penalty a match, largest penalty, matches it takes) of uncertainty; case-insensitive.
UNCERTAINTY = (
    (r"\b(i\s+think|i\s+believe|i\s+assume|i\s+guess|not\s+sure|unsure|uncertain|don'?t\s+know|can'?t\s+remember|don'?t\s+recall|forgot|unclear)\b", "explicit_uncertainty", 0.2, 0.5, 1),
    (r"\b(maybe|perhaps|possibly|probably|might|could\s+be|seems?\s+like|appears?\s+to|looks?\s+like|sort\s+of|kind\s+of|somewhat|roughly|approximately|more\s+or\s+less|in\s+a\s+way|to\s+some\s+extent)\b", "hedging_language", 0.1, 0.3, 1),
    (r"\b(if|unless|depending|depends|when|provided\s+that|assuming|in\s+case|should\s+be|would\s+be|could\s+be)\b", "conditional", 0.05, 0.2, 1),
    (r"\b(supposedly|allegedly|reportedly|rumor|heard\s+that|someone\s+said|they\s+say|word\s+is|speculation|guessing|estimate|ballpark|guesstimate)\b", "speculative", 0.15, 0.4, 1),
    (r"\b(some|many|few|several|most|often|sometimes|rarely|occasionally|frequently|various|certain|a\s+lot|bunch\s+of|tons\s+of|handful)\b", "vague_quantification", 0.03, 0.15, 1),
    (r"\b(but|however|although|yet|on\s+the\s+other\s+hand|alternatively|conversely|in\s+contrast|then\s+again|actually|wait|no|rather|instead)\b", "contradiction", 0.08, 0.25, 2),
    (r"\b(used\s+to|was|were|before|previously|formerly|back\s+then|at\s+the\s+time|outdated|old|last\s+(year|month|week)|ago|recently\s+changed)\b", "temporal_uncertainty", 0.05, 0.2, 1),
)

# Dates in text.
DATES = (r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b")

# Weights of message importance.
IMPORTANCE = {"recency": 0.20, "is_first_message": 0.15, "is_last_exchange": 0.10, "has_code": 0.08, "has_structured_data": 0.05, "has_names_entities": 0.05, "has_decisions": 0.05, "has_questions": 0.03, "is_system": 0.15}
# Fixed values: (feature, pattern) of message importance.
FEATURES = (
    ("has_code", r"```[\s\S]*?```|`[^`]+`|(?m)^\s{4,}\S"),
    ("has_structured_data", r"\{[\s\S]*\}|\[[\s\S]*\]|(?m)^\s*[-*]\s|(?m)^\s*\d+\.\s|\|.*\|"),
    ("has_names_entities", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b|\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b|\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b|https?://\S+"),
    ("has_decisions", r"(?i)\b(?:decided|decision|conclude|concluded|therefore|thus)\b|(?i)\b(?:will|should|must|need to)\b|(?i)\b(?:answer is|solution is|result is)\b|(?i)\b(?:in summary|to summarize|in conclusion)\b"),
    ("has_questions", r"\?"),
)

_TITLE = r"(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?|Sir|Dame|Lord|Lady|President|CEO|CTO|CFO|Director|Manager|Senator|Governor|Mayor|Captain|General|Admiral)"
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
# Fixed values: (pattern, type) of entities; case-sensitive, group 1 is the name.
ENTITIES = (
    (r"(" + _TITLE + r"\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", "person"),
    (r"\b([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", "person"),
    (r"\b([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?|Company|Co\.?|Corporation|Group|Foundation|Institute|University|College|Association|Organization|Agency|Department|Ministry|Commission))\b", "organization"),
    (r"\b([A-Z]{3,})\b", "organization"),
    (r"\b(The\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Company|Corporation|Foundation|Institute|Organization|Agency|Commission))\b", "organization"),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:City|State|Country|County|Province|District|Region|Island|Mountain|River|Lake|Ocean|Sea|Valley|Desert|Forest|Park))\b", "location"),
    (r"\b((?:North|South|East|West|Northern|Southern|Eastern|Western)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b", "location"),
    (r"(?:in|at|from|to|near)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b", "location"),
    (r"\b(" + _MONTH + r"\s+\d{1,2},?\s+\d{4})\b", "date"),
    (r"\b(\d{1,2}\s+" + _MONTH + r"\s+\d{4})\b", "date"),
    (r"\b(\d{4}[-/]\d{2}[-/]\d{2})\b", "date"),
    (r"\b(" + _MONTH + r"\s+\d{4})\b", "date"),
    (r"\b(The\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Conference|Summit|Meeting|Convention|Festival|Games|Olympics|Championship|Tournament|War|Battle|Revolution|Crisis))\b", "event"),
    (r"\b(World\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b", "event"),
    (r"\b([A-Z][a-z]+[A-Z][A-Za-z]*(?:\s+\d+)?)\b", "product"),
    (r"\b([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+\d+)?(?:\s+(?:Pro|Plus|Max|Mini|Ultra|Lite))?)\b", "product"),
)
# Words that look like entities and are none.
NO_ENTITIES = """the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must shall can need dare ought used it its
this that these those i you he she we they them their his her my your our said says told asked replied answered stated monday tuesday wednesday thursday friday saturday sunday today tomorrow
yesterday now then here there what when where why how which who however therefore meanwhile furthermore moreover nevertheless although because since while during before after until unless""".split()

# Fixed values: (pattern, kind) of key facts in messages; case-insensitive, group 1 is the fact.
KEY_FACTS = (
    (r"\b(?:is|are|was|were)\s+(\d+)", "number"),
    (r"\b(?:named?|called)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", "name"),
    (r"\b(?:on|at|by)\s+(\d{4}[-/]\d{2}[-/]\d{2})", "date"),
    (r"\b(?:decided|concluded|determined)\s+(?:that\s+)?(.+?)[.!?]", "decision"),
    (r"\[(?:CRITICAL|IMPORTANT|KEY)\](.+?)(?:\[|$|\n)", "critical"),
    (r"(?:result|answer|output)(?:\s+is)?:\s*(.+?)(?:[.!?\n]|$)", "result"),
    (r"```[\w]*\n?([\s\S]*?)```", "code"),
)
# First words of query kinds, in the order of the tests, and the semantic weight of each kind.
QUERY_STARTS = (
    ("navigational", ("find", "locate", "show me", "get", "open", "go to")),
    ("conceptual", ("how", "why", "explain", "describe", "what is the reason")),
    ("factual", ("who", "what", "when", "where", "which", "how many", "how much")),
)
QUERY_WEIGHTS = {"factual": 0.5, "conceptual": 0.9, "navigational": 0.3, "exploratory": 0.7, "similarity": 1.0}
