r"""Word lists and patterns whose every entry decides results, kept as they were given.

Java and RE2 read `\b`, `\w` and `\d` alike (ASCII), so the patterns serve the queries and their SQL.
"""

# Words that carry no topic.
STOP_CONTENT = (
    "every", "always", "never", "often", "after", "early", "later", "other",
    "there", "their", "these", "those", "where", "which", "would", "could",
    "should", "might", "morning", "evening", "tonight", "today", "yesterday",
    "really", "quite", "about", "still", "great", "little", "being",
    "getting", "doing", "having", "going", "coming", "think", "things",
    "people", "place", "right", "first", "again", "still", "using",
    "before", "since", "while", "every", "truly", "until",
)

# Words that say nothing of an attribute.
STOP_UPDATE = tuple(
    "the a an of in on at to for with and or is are was were has have had "
    "user their they them my i we he she it that this be been being do "
    "does did not no like likes want wants around usually about".split()
)

# Words that support no fact.
STOP_FACT = tuple(
    """the user that this with have been from they them were
about their would could should there where which while during session dated
was has had are you for not but all can get got its his her our out now one
and the very much many more also just like some went goes going
""".split()
)

# Words that no gold answer hangs on.
STOP_GOLD = (
    "the", "and", "for", "with", "that", "this", "you", "your", "was", "were",
    "have", "has", "had", "are", "not", "but", "from", "they", "their", "them",
    "when", "what", "which", "would", "could", "should", "about", "into",
    "user", "users", "there", "then", "than", "some", "just", "also", "been",
    "will", "can", "may", "his", "her", "its", "our", "out", "one", "all",
)

# Categories of user turns, the first of equals wins.
TRIGGERS = (
    ("bug_report", r"\b(bug|error|crash\w*|fail\w*|exception|broken|not work\w*)"),
    ("feature_request", r"\b(add|implement\w*|build\w*|create\w*|feature|want|need|would like)"),
    ("question", r"\b(how|what|why|when|where|explain\w*|tell me|help\b)"),
    ("code_review", r"\b(review\w*|check\w*|look at|feedback|improve\w*|refactor\w*)"),
    ("debugging", r"\b(debug\w*|trace\w*|stack trace|why is|what is wrong)"),
    ("planning", r"\b(plan\w*|design\w*|architect\w*|roadmap|structure|outline\w*)"),
    ("clarification", r"\b(clarif\w*|unclear|confus\w*|rephrase\w*)"),
)

# How a category reads in a pattern.
TRIGGER_TEXT = {
    "bug_report": "user reports a bug",
    "feature_request": "user requests a feature",
    "question": "user asks a question",
    "code_review": "user asks for code review",
    "debugging": "user is debugging",
    "planning": "user needs planning help",
    "clarification": "there is ambiguity",
    "general": "user sends a message",
}

# What a reply did, the first match wins.
ACTIONS = (
    (r"\basked for\b.{5,60}", "asked for clarification"),
    (r"\bprovided\b.{5,60}", "provided information"),
    (r"\bsuggest\w*.{5,60}", "suggested solution"),
    (r"\bexplain\w*.{5,60}", "explained concept"),
    (r"\bwrote\b.{5,60}code", "wrote code"),
    (r"\brefactored\b.{5,60}", "refactored code"),
    (r"\bdiagnosed\b.{5,60}", "diagnosed issue"),
    (r"\bcreated\b.{5,60}", "created artifact"),
    (r"\breviewed\b.{5,60}", "reviewed content"),
    (r"\blisted\b.{5,60}", "listed items"),
    (r"```", "provided code block"),
)

# Intents of a question, over lower-cased text.
RECALL = (
    r"(previous|earlier|last|past|our)\s+(conversation|chat|discussion|talk|session)"
    r"|\bwe (discussed|talked|spoke)\b"
    r"|\byou (told|mentioned|said|recommended|suggested|gave)\b"
    r"|\bremind me\b|\bgoing back to\b|\blooking back\b|\bfollow up on\b"
)
TOTALS = r"\b(how many|how much|how often|how old|in total|altogether|total (number|cost|amount|days))\b"
ADVICE = (
    r"\b(recommend(ed|s|ations?)?|suggest(ed|s|ions?)?|advice|tips?|ideas?)\b"
    r"|\bshould i\b|\bdo you think\b|\bwhat do you think\b"
    r"|\bhelp me (choose|pick|decide)\b"
)

# Openings by which users say who they are, over lower-cased text.
IDENTITY = r"\b(my name|i am|i work|i live|i study|i use|i prefer|i graduated|before i|i was at)\b"

# Values of an attribute, and words that narrow when it holds.
VALUE = r"\b\d[\d,.:]*\s?(?:am|pm|AM|PM)?\b"
QUALIFIERS = {
    "weekday": ("weekday", "weekdays", "monday", "tuesday", "wednesday", "thursday", "friday", "mondays", "tuesdays", "wednesdays", "thursdays", "fridays"),
    "weekend": ("weekend", "weekends", "saturday", "sunday", "saturdays", "sundays"),
    "morning": ("morning", "mornings"),
    "evening": ("evening", "evenings", "night", "nights"),
}

# Numbers as words, and relative dates with the days they reach back, from and to.
NUMERALS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8}
AGO = r"(\d+|a|an|one|two|three|four|five|six|seven|eight)\s+(day|week|month)s?\s+ago"
REACH = (
    (r"\ba couple of days ago\b", 7, 0),
    (r"\blast\s+(saturday|sunday|monday|tuesday|wednesday|thursday|friday)\b", 10, 0),
    (r"\blast week\b", 14, 2),
    (r"\b(past|last) month\b", 35, 0),
    (r"\byesterday\b", 2, 0),
)

# Characters that show nothing, and marks of direction.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff"
BIDI = "\u202a\u202b\u202c\u202d\u202e"
