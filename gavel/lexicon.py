"""Every pattern list, word list, table and threshold the operators share.

All entries below are FIXED VALUES. Results depend on them letter by letter, so they are written out as
plain text, in their natural order, and nothing else in the package repeats them. Patterns are regular
expressions in the syntax subset shared by Java and RE2, without flags; callers add the flags they need.
"""

# --- fixed values: transcript line formats -------------------------------------------------------------
TIMESTAMP_LINE = r"^\[(\d{1,2}:\d{2}:\d{2})\]\s*(.+?):\s*(.+)$"
SHORT_TIMESTAMP_LINE = r"^\[(\d{1,2}:\d{2}(?::\d{2})?)\]\s*(.+?):\s*(.+)$"
DASH_LINE = r"^([A-Za-z\s]+?)\s+-\s+(.+)$"
UNKNOWN_SPEAKER = "unknown"
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
UPLOAD_SUFFIX = ".txt"

# --- fixed values: cleaning ----------------------------------------------------------------------------
FILLER_WORDS_SPOKEN = r"\bum\b|\buh\b|\blike\b(?!\s+\w+ing)"
PHRASE_DICTIONARY = [
    ("prepone", "move earlier"),
    ("do the needful", "take necessary action"),
    ("revert back", "reply"),
    ("kindly", ""),
    ("pls", "please"),
    ("pl", "please"),
    ("abt", "about"),
    ("asap", "as soon as possible"),
    ("tym", "time"),
    ("f2f", "face to face"),
]

STOP_SENTENCES = [
    r"^(good\s+(morning|afternoon|evening|night)|hello|hi\s+everyone)\b",
    r"^(thanks?|thank\s+you)(\s+everyone|\s+all|\s+guys?)?\s*[.!]?$",
    r"^(have\s+a\s+(good|great|nice)).*week",
    r"^(sounds?\s+good|great[.!]?|perfect[.!]?|awesome[.!]?)$",
    r"^\w+[.!?]?$",
    r"^(yes|no|ok|okay|sure|agreed?)[,.]?$",
    r"^(yeah|yep|nope|hmm|right)[.!]?$",
    r"^(one\s+(last|more)\s+thing)\b",
    r"^(anyway|alright|so+|well+)[,.]",
    r"^(quick\s+standup|let'?s\s+go\s+around)\b",
    r"^let\s+me\s+know\b",
    r"^appreciate\s+it\b",
    r"^makes\s+sense\b",
    r"^(anything\s+else|any\s+(other|questions|concerns))\b",
    r"^what'?s\s+your\s+(status|update|progress)\b",
    r"^(good\s+idea|i\s+like\s+that|i\s+agree)\b",
    r"^(that'?s\s+great|that'?s\s+good|that'?s\s+interesting)\b",
    r"^\s*[.!?,;:\-]+\s*$",
    r"^(got\s+it|will\s+do|no\s+problem|absolutely|definitely|exactly)\b",
    r"^(fine[.!]?|sure\s+thing)\b",
]

# --- fixed values: sentence types ----------------------------------------------------------------------
METRIC_SENTENCES = [
    r"\d+\s*%",
    r"(revenue|conversion|churn|growth|retention)\s+(rate|is|was|went)",
]
OBSERVATION_SENTENCES = [
    r"\b(is|are|was|were)\s+(up|down|good|bad|high|low)\b",
    r"(compared\s+to|went\s+from|helped\s+drive|switched\s+to)",
    r"\b(seems?|appears?|looks?)\s+(to\s+be|like)?\s*(good|fine|well|working)",
]
CONSEQUENCE_SENTENCES = [
    r"(will\s+be\s+happy|will\s+be\s+pleased|should\s+be\s+fine)",
    r"(that'?s\s+(great|good|concerning|interesting|valid))",
]

# --- fixed values: triplet resolution ------------------------------------------------------------------
WEAK_TRIPLET_VERBS = ["be", "have", "do", "go", "get", "make", "let"]
TRIPLET_PRONOUNS = ["it", "that", "this", "them", "those", "these", "you", "me", "him", "her", "us"]
TEMPORAL_OBJECTS = [
    "weekend", "afternoon", "day",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
]
FIXED_ADDRESSEES = ["PM", "Dev1", "Dev2", "QA", "Designer", "Everyone"]
RESULTATIVE_VERBS = ["have", "get", "make", "keep"]
TRIPLET_PENALTY = {
    "resolved_via_context": 0.2,
    "unresolved_pronoun_subject": 0.2,
    "unresolved_pronoun_object": 0.2,
    "weak_root_verb": 0.15,
    "null_subject": 0.2,
    "null_object": 0.1,
}

# --- fixed values: dependency annotation ---------------------------------------------------------------
LIGHT_ROOTS = [
    "go", "have", "let", "be", "will", "would", "could", "should", "may", "might", "must", "can",
]
OBJECT_PRIORITY = {"dobj": 1, "obj": 1, "iobj": 2, "attr": 3, "pobj": 4}
OBJECT_TEMPORAL_HEADS = ["by", "at", "in", "before", "after", "during", "over", "upon", "throughout"]

# --- fixed values: meeting type ------------------------------------------------------------------------
TASK_SIGNALS = [
    "will", "shall", "need to", "going to", "i'll", "let's",
    "by friday", "by tomorrow", "deadline", "assign", "handle",
    "responsible", "action item", "follow up", "must", "should",
]
STATUS_SIGNALS = [
    "numbers", "revenue", "growth", "churn", "metrics", "quarter",
    "percent", "compared to", "went from", "is up", "is down",
    "looking good", "seems", "appears", "update on", "status update",
    "performance", "results", "week", "month", "year over year",
]
STATUS_DOMINANCE = 1.5

# --- fixed values: rule detector -----------------------------------------------------------------------
NON_ACTION_SENTENCES = [
    r"^\s*good\s+(morning|afternoon|evening|day)\b",
    r"^\s*(hi|hello|hey|welcome)\b",
    r"^\s*thanks?\s+(for|everyone|all)\b",
    r"^\s*(sure|perfect|great|sounds?\s+good|agreed|absolutely|no\s+problem"
    r"|will\s+do|okay|ok|fine|right|exactly|definitely)\s*\.?\s*$",
    r"^\s*let'?s\s+(start|begin|get\s+started|move\s+on|kick\s+off"
    r"|meet\s+again|schedule\s+(a\s+)?follow|wrap\s+up)\b",
    r"^\s*the\s+\w+\s+(is|are|was|were)\s+(too|very|really)\b",
]
DETECTION_VERBS = (
    r"\b(prepare|create|write|send|deploy|build|design|test|review|approve"
    r"|schedule|organize|coordinate|finalize|update|implement|document"
    r"|setup|configure|integrate|optimize|monitor|debug|fix|investigate"
    r"|analyze|research|verify|validate|check|plan|propose|suggest"
    r"|draft|outline|summarize|compile|generate|migrate|refactor|audit)\b"
)
MIN_DECISION_WORDS = 4
SHARED_ACTION_VERBS = (
    r"\b(prepare|create|write|send|deploy|build|design|test|review|approve"
    r"|schedule|organize|coordinate|finalize|update|implement|document"
    r"|setup|configure|integrate|optimize|monitor|debug|fix|investigate"
    r"|analyze|research|verify|validate|check|plan|propose|suggest"
    r"|draft|outline|summarize|compile|generate|migrate|refactor|audit"
    r"|handle|improve|run|submit|develop|maintain|prioritize)\b"
)
SHARED_DEADLINES = [
    r"\bby\s+(end\s+of\s+)?(next\s+)?"
    r"(monday|tuesday|wednesday|thursday|friday|saturday|sunday"
    r"|january|february|march|april|may|june"
    r"|july|august|september|october|november|december"
    r"|tomorrow|today|week|month|quarter)\b",
    r"\b(next|this)\s+(week|month|quarter)\b",
    r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    r"\b\d{1,2}/\d{1,2}(/\d{2,4})?\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
]
SPEAKER_NAME = r"^[A-Z][a-z]+$"

# --- fixed values: detection features ------------------------------------------------------------------
HARD_FILTERS = [
    r"^(good|great|agreed?|sounds\s+good|ok|okay|sure|hmm|yeah|yes|no)\.*$",
    r"^(that'?s\s+(great|good|interesting|concerning|valid|a\s+valid\s+point))\.*$",
    r"^anything\s+else",
    r"^(i\s+think\s+that\s+covers|have\s+a\s+good)",
    r"\d+\s*%.*compared\s+to",
    r"(board|team|everyone)\s+will\s+be\s+(happy|pleased|fine)",
    r"(helped\s+drive|really\s+helped)",
    r"switched\s+to\s+a\s+competitor",
]
# Searched modals with their strength, longest phrase first; equal lengths by strength, then by name.
MODALS = [
    ("required to", 0.90),
    ("expected to", 0.85),
    ("supposed to", 0.75),
    ("ought to", 0.80),
    ("have to", 0.95),
    ("need to", 0.95),
    ("should", 0.85),
    ("shall", 0.85),
    ("would", 0.70),
    ("could", 0.40),
    ("might", 0.30),
    ("must", 1.0),
    ("will", 0.80),
    ("can", 0.50),
    ("may", 0.40),
]
LETS_STRENGTH = 0.85
DIRECT_OBJECT_BONUS = 0.10
TYPE_PRIORS = {"observation": 0.2, "consequence": 0.25, "metric": 0.15, "general": 0.7}
STATUS_MEETING_FACTOR = 0.7
SUGGESTION_PRIOR = 0.5
SUGGESTION_MARKERS = [
    r"\b(maybe|perhaps|could\s+we|might\s+we|what\s+if|think|suggest|consider)\b",
    r"\b(in\s+my\s+opinion|i\s+think|i\s+believe|it\s+seems)\b",
]
NEGATIONS = [
    r"\b(not|no|don't|doesn't|didn't|won't|wouldn't|can't|cannot|shouldn't|couldn't|shan't)\b",
    r"\b(never|nowhere|nothing|nobody|no\s+one)\b",
    r"\b(aren't|isn't|wasn't|weren't|haven't|hasn't|hadn't)\b",
]
PAST_WORDS = [
    "finished", "completed", "found", "lost", "switched",
    "helped", "went", "heard", "complained", "mentioned",
]
PROGRESSIVE_WORDS = ["working", "testing", "monitoring", "running"]
PAST_PRIOR = 0.2
PROGRESSIVE_PRIOR = 0.3
REQUESTS = [
    r"\b(can\s+you|could\s+you|would\s+you|will\s+you|can\s+someone|could\s+someone)\b",
    r"\b(please|would\s+it\s+be\s+possible|is\s+it\s+possible|need\s+help)\b",
    r"\b(i\s+need|we\s+need|we\s+should|let's)\b",
]
ACCEPTANCES = [
    r"\b(yes|sure|okay|ok|yeah|yep|sounds\s+good|will\s+do|can\s+do)\b",
    r"\b(i'll|i\s+will|i\s+can|i\s+can\s+handle|i\s+can\s+take)\b",
    r"\b(absolutely|definitely|of\s+course|no\s+problem)\b",
]
KEEP_CLASSES = ["decision", "commitment"]
ZONE_HIGH = 0.7
ZONE_REVIEW = 0.4
HARD_FILTER_CONFIDENCE = 0.1
NEGATED_CONFIDENCE = 0.1
MODAL_WEIGHT = 0.3
CONTEXT_WEIGHT = 0.4
FEATURE_WEIGHT = 0.6
PAIR_CONFIDENCE_FLOOR = 0.8
PAIR_CONFIDENCE = 0.85
CONTEXT_SENTENCES = 2
CONTEXT_SEPARATOR = " [SEP] "

# --- fixed values: assignee and deadline ---------------------------------------------------------------
SELF_SUBJECTS = ["i", "me"]
TEAM_SUBJECTS = ["we", "team", "everyone", "all"]
TEAM_ASSIGNEE = "team"
GENERIC_SPEAKERS = ["speaker1", "speaker2", "person1", "person2", "participant"]
DEADLINES = [
    r"\bby\s+(end\s+of\s+)?(next\s+)?"
    r"(monday|tuesday|wednesday|thursday|friday|saturday|sunday"
    r"|january|february|march|april|may|june"
    r"|july|august|september|october|november|december"
    r"|tomorrow|today|tonight|week|month|quarter"
    r"|Q[1-4])\b",
    r"\bnext\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday"
    r"|week|month|quarter)\b",
    r"\bend\s+of\s+(the\s+)?"
    r"(monday|tuesday|wednesday|thursday|friday|saturday|sunday"
    r"|january|february|march|april|may|june"
    r"|july|august|september|october|november|december"
    r"|week|month|quarter)\b",
    r"\b(january|february|march|april|may|june"
    r"|july|august|september|october|november|december)"
    r"\s+\d{1,2}\b",
    r"\b\d{1,2}\s+(january|february|march|april|may|june"
    r"|july|august|september|october|november|december)\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}/\d{1,2}(/\d{2,4})?\b",
    r"\btomorrow\b",
    r"\btoday\b",
]
INVALID_DEADLINES = [
    r"^\s*(morning|afternoon|evening|night)\s*$",
    r"\b(last|previous|earlier|recently|ago)\b",
    r"^\s*the\s+task\s+week\s*$",
]
DEADLINE_ANCHORS = (
    r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday"
    r"|january|february|march|april|may|june|july|august|september"
    r"|october|november|december"
    r"|tomorrow|today|tonight|end\s+of"
    r"|next\s+week|next\s+month|next\s+quarter"
    r"|Q[1-4])\b"
)

# --- fixed values: task titles -------------------------------------------------------------------------
VERB_IMPERATIVES = {
    "look": "Investigate", "monitor": "Monitor", "revisit": "Revisit", "keep": "Continue monitoring",
    "follow": "Follow up on", "check": "Check", "review": "Review", "deploy": "Deploy", "write": "Write",
    "create": "Create", "build": "Build", "fix": "Fix", "test": "Test", "update": "Update",
    "send": "Send", "prepare": "Prepare", "schedule": "Schedule", "organize": "Organize",
    "coordinate": "Coordinate", "finalize": "Finalize", "implement": "Implement",
    "document": "Document", "design": "Design", "refactor": "Refactor", "audit": "Audit", "add": "Add",
    "draft": "Draft", "redesign": "Redesign", "investigate": "Investigate", "analyze": "Analyze",
    "verify": "Verify", "validate": "Validate", "plan": "Plan", "propose": "Propose",
    "suggest": "Suggest", "summarize": "Summarize", "compile": "Compile", "generate": "Generate",
    "migrate": "Migrate", "integrate": "Integrate", "optimize": "Optimize", "debug": "Debug",
    "resolve": "Resolve", "improve": "Improve", "establish": "Establish", "run": "Run",
    "submit": "Submit", "develop": "Develop", "maintain": "Maintain", "prioritize": "Prioritize",
}
WEAK_TITLE_VERBS = [
    "be", "have", "do", "go", "get", "make", "seem", "appear",
    "look", "feel", "become", "need", "think", "know",
]
EMPTY_OBJECTS = [
    "that", "it", "this", "them", "those", "these",
    "something", "anything", "nothing", "everything",
    "one", "he", "she", "they", "we", "i",
]
CONVERSATIONAL_OPENINGS = [
    r"^i\s+think\s+",
    r"^we\s+should\s+",
    r"^I\s+will\s+",
    r"^you\s+should\s+",
    r"^i\s+need\s+to\s+",
    r"^i'?m\s+going\s+to\s+",
    r"^we'?ll\s+",
]
TITLE_FILLERS = [
    r"\bfirst\b", r"\bjust\b", r"\bactually\b", r"\bbasically\b",
    r"\bprobably\b", r"\bdefinitely\b", r"\bkind of\b", r"\bsort of\b",
]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
NON_TASK_SENTENCES = [
    r"^\s*good\s+(morning|afternoon|evening)\b",
    r"^\s*(hi|hello|hey|welcome)\b",
    r"\b(meet\s+again|schedule\s+(a\s+)?follow.?up)\b",
    r"^\s*(sounds?\s+good|perfect|great|agreed)\b",
]
GENERATED_TASK_VERBS = (
    r"\b(handle|fix|write|create|update|review|deploy|test|configure"
    r"|audit|document|design|build|refactor|implement|prepare|set\s+up"
    r"|increase|add|draft|redesign|look\s+into|investigate|check"
    r"|monitor|migrate|integrate|optimize|schedule|resolve|improve"
    r"|analyze|coordinate|establish|run|send|submit|develop|maintain|prioritize)\b"
)

# --- fixed values: task confidence and validity --------------------------------------------------------
CONFIDENCE_WEIGHTS = {"detection": 0.5, "completeness": 0.2, "assignment": 0.15, "deadline": 0.15}
REVIEW_FROM, REVIEW_BELOW = 0.5, 0.7
MIN_TASK_CONFIDENCE = 0.5
MIN_STATUS_MEETING_CONFIDENCE = 0.65
MIN_TYPED_SENTENCE_CONFIDENCE = 0.75
TYPED_SENTENCES = ["observation", "consequence", "metric"]
INVALID_TASK_TEXTS = [
    r"^\d+\s*%\s*(up|down|growth|decline)",
    r"(revenue|churn|conversion)\s+(is|was)\s+\d+%",
    r"(compared\s+to|went\s+from).*\d+%",
    r"^(that'?s|it'?s|things?\s+are)\s+\w+\.$",
    r"^(great|good|cool|interesting|valid)[\.\!\?]*$",
    r"^anything\s+else",
    r"^(what|any|do you have)",
    r"^(wow|fantastic|awesome|horrible|terrible)[\.\!\?]*$",
]
DUPLICATE_SIMILARITY = 0.8

# --- fixed values: evaluation --------------------------------------------------------------------------
PARTIAL_MATCH_RATIO = 0.7
FUZZY_DECISION_RATIO = 0.8
SEMANTIC_TASK_COSINE = 0.8
SEMANTIC_DECISION_COSINE = 0.85

# --- fixed values: task board --------------------------------------------------------------------------
TASK_STATUSES = ["BACKLOG", "TODO", "IN_PROGRESS", "IN_REVIEW", "DONE", "CANCELLED"]
TASK_PRIORITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
REVIEW_STATUSES = ["PENDING", "APPROVED", "REJECTED", "MODIFIED"]
NEAR_DAYS = 2
CLEANUP_NAMES = "TEST|DEMO|demo|test"
ACTIVE_JOBS = ["pending", "running"]
RETRYABLE_JOBS = ["failed", "timeout"]
TERMINAL_JOBS = ["completed", "failed", "cancelled", "timeout"]
MAX_ACTIVE_JOBS = 3
JOB_STEPS = 6
PLACEHOLDER_ASSIGNEES = ["unknown", "none", "team", ""]
UNTITLED = "Untitled"
NO_ITEMS_SUMMARY = "Meeting processed successfully. No action items were extracted."
UPLOAD_MEETING_TITLE = "Transcript Upload"
RESPONSE_CONTRACTS = {
    "POST /auth/login": {"required_keys": ["user", "token"], "nested": {"user": ["id", "email", "fullName"]}},
    "POST /auth/signup": {"required_keys": ["id", "email", "fullName"]},
    "GET /auth/me": {"required_keys": ["id", "email", "fullName", "isActive"]},
    "GET /projects": {"is_array": True},
    "GET /tasks": {"is_array": True},
    "GET /transcripts": {"is_array": True},
    "GET /processing/*/status": {
        "required_keys": ["jobId", "status", "currentStep", "stepLabel", "progress"]
    },
    "GET /notifications": {"is_array": True},
}

# --- fixed values: decision clusters -------------------------------------------------------------------
POSITION_DECAY = 0.05
MIN_COSINE = 0.40
OBJECT_MISMATCH_FACTOR = 0.6
CLUSTER_DISTANCE = 0.70
SUMMARY_PRONOUNS = [("it", "the system"), ("them", "the items"), ("this", "the task")]
SELF_ASSIGNMENT = ["I will", "I'll", "I can", "let me"]
DELEGATION = ["can you", "could you"]

# --- fixed values: conversational openings of cluster sentences, longest first --------------------------
CLUSTER_OPENINGS = [
    r"^also\s+we\s+need\s+to\s+",
    r"^maybe\s+we\s+should\s+",
    r"^i\s+think\s+we\s+should\s+",
    r"^i\s+will\s+also\s+",
    r"^i\s+think\s+",
    r"^we\s+should\s+",
    r"^we\s+need\s+to\s+",
    r"^i\s+need\s+to\s+",
    r"^can\s+you\s+",
    r"^could\s+you\s+",
    r"^you\s+should\s+",
    r"^i\s+will\s+",
    r"^i'?ll\s+",
    r"^we'?ll\s+",
    r"^we\s+will\s+",
    r"^let\s+me\s+",
    r"^let'?s\s+",
    r"^please\s+",
    r"^also\s+",
]
