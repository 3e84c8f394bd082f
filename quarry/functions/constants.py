"""Fixed values that decide results. They are stated as they are matched: phrases in lower case."""

# Messages that are never worth keeping.
TRIVIAL_PHRASES = [
    "ok", "yes", "no", "sure", "yep", "nope", "k", "yeah", "nah", "alright", "right", "cool", "nice", "great", "perfect", "fine", "agreed", "understood", "noted", "thanks", "ty", "thx",
    "lol", "lmao", "haha", "hm", "hmm", "ah", "oh", "hey", "hi", "hello", "bye", "goodbye", "yo", "sup", "wow", "omg", "brb", "gtg", "idk", "imo", "tbh", "smh", "ikr", "np", "gg", "ez", "rip",
    "oof", "yikes", "meh", "duh", "oops", "ugh", "yay", "woo", "okay", "got it", "sounds good", "makes sense", "that works", "no problem", "no worries", "of course", "my bad", "my mistake",
    "will do", "good point", "fair enough", "for sure", "all good", "thank you", "good luck", "take care", "see ya", "you too", "same here", "oh well", "oh no", "ha ha", "he he", "me too",
    "ok sounds good", "yes thats right", "no thats wrong", "that makes sense", "thats fine", "sure thing", "youre right", "i agree", "i see", "i understand", "ok cool", "yep got it",
    "sounds great", "no doubt", "for real", "oh i see", "ok thanks", "thanks a lot", "much appreciated",
]

# Words that say nothing by themselves.
TRIVIAL_WORDS = [
    "ok", "yes", "no", "sure", "yeah", "nah", "right", "cool", "nice", "great", "perfect", "fine", "thanks", "lol", "haha", "wow", "oh", "ah", "hmm", "hey", "hi", "hello", "bye", "yo", "the",
    "a", "an", "i", "it", "is", "was", "and", "or", "but", "so", "just", "very", "really", "too", "also", "well", "like", "um", "uh",
]

# Words that stand for each other in a query.
SYNONYM_GROUPS = [
    ["search", "find", "look for", "query", "retrieve"],
    ["create", "build", "make", "construct", "implement"],
    ["delete", "remove", "drop", "erase", "destroy"],
    ["update", "modify", "change", "edit", "alter"],
    ["fast", "quick", "rapid", "speedy", "performant"],
    ["error", "bug", "issue", "problem", "defect"],
    ["memory", "recall", "remember", "recollection"],
]

# Short forms and what they stand for.
ACRONYMS = [
    ("API", "Application Programming Interface"), ("DB", "database"), ("database", "DB"), ("ML", "Machine Learning"), ("AI", "Artificial Intelligence"), ("LLM", "Large Language Model"),
    ("PR", "Pull Request"), ("CI", "Continuous Integration"), ("CD", "Continuous Deployment"), ("CI/CD", "Continuous Integration / Continuous Deployment"), ("ORM", "Object Relational Mapper"),
    ("SDK", "Software Development Kit"), ("CLI", "Command Line Interface"), ("GUI", "Graphical User Interface"), ("HTTP", "Hypertext Transfer Protocol"), ("SQL", "Structured Query Language"),
    ("NoSQL", "Not only SQL"), ("OS", "Operating System"), ("CPU", "Central Processing Unit"), ("GPU", "Graphics Processing Unit"),
]

# Words about time and looser ones.
TEMPORAL_EXPANSIONS = [
    ("yesterday", ["today", "recent", "last few days"]),
    ("today", ["now", "current", "this moment"]),
    ("last week", ["this week", "recent", "recently"]),
    ("this week", ["recent", "last few days", "lately"]),
    ("recently", ["last few days", "this week", "today"]),
    ("next month", ["upcoming", "soon", "in the future"]),
    ("last month", ["recent", "last few weeks", "previously"]),
]

# Word ends and what may stand in their place; the first that fits counts.
MORPHOLOGY = [("ing", ["ed", "s", "ion"]), ("ed", ["ing", "s"]), ("ly", [""]), ("tion", ["te"]), ("ations", ["ate"]), ("ies", ["y", "ied"]), ("s", [""])]

# A user turn that holds one of these corrects what was said.
CORRECTION_CUES = ["no,", "no ", "actually,", "actually ", "thats wrong", "not quite", "correction:", "to clarify", "i meant", "what i meant", "let me clarify", "to be clear"]

# Texts that hold one of these may try to steer a model; the first that is found counts.
SUSPICIOUS_PATTERNS = [
    "ignore previous", "ignore all previous", "disregard previous", "system:", "<system>", "assistant:", "<|im_start|>", "<|im_end|>", "you are now", "pretend you are", "act as", "jailbreak",
    "override instructions", "new instructions:", "prompt injection",
]

# Authority of a source channel; any other has 0.2.
SOURCE_AUTHORITY = {"user_correction": 1.0, "conversation": 0.7, "system": 0.4}
OTHER_AUTHORITY = 0.2
