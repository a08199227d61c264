"""Lists, patterns and constants that results depend on."""

# --- fixed values ----------------------------------------------------------------------------------
SUFFIXES = "tion sion ment ness able ible ting ling ning ring sing ying ied ies ing ted sed red ned led ked ers ors ess ful ous ive ize ed ly er or es al".split()

SOUNDEX_LETTERS, SOUNDEX_DIGITS = "BFPVCGJKQSXZDTLMNR", "111122222222334556"

COMMANDS = "npm git pip apt ssh curl docker".split()

PRIORITY_TYPES = "user_correction repeated_correction user_preference frustrated_correction universal_directive".split()
CORRECTION_TYPES = "USER_CORRECTION REPEATED_CORRECTION USER_PREFERENCE FRUSTRATED_CORRECTION".split()
PROTECTED_TYPES = "USER_CORRECTION repeated_correction frustrated_correction".split()
VALID_TYPES = (
    "ARCHITECTURAL_DECISION WORKING_SOLUTION FAILED_APPROACH CODEBASE_PATTERN USER_PREFERENCE USER_CORRECTION"
    " CONFIG_INSIGHT DEBUGGING_INSIGHT error_resolution"
).split()

INTENT_STOP_WORDS = """
a an the is are was were be been being have has had do does did will would could should can may might shall must
to of in for on with at by from as into about between through during before after
i me my mine you your yours we our us he she it they them his her its their
this that these those which what who whom and but or nor not no if so yet
just how why when where then than also very too quite really much more most some
any all each every both few many such like want need know think look make get
got let say said tell told give gave take took come came going went see saw
last night yesterday today now here there still already even well back only again
new old used using use way thing things right sure okay yeah yes please thanks
help show find remember don didn doesn working project stuff done lot trying started start
""".split()

TAG_STOP_WORDS = """
a an the is are was be been have has do does did will would could should can
to of in for on with at by from as i me my you your we it this that
and but or if so just how what why not don use make get set put try
no yes never always stop keep told said instead already again like want need think
""".split()

SYSTEM_MARKERS = [
    "You are a lead engineer reviewing",
    "You are a plan reviewer",
    "Output ONLY valid JSON",
    "Extract learnings from this session",
]
TASK_NOTIFICATION = "<task-notification>"

CORRECTION_SIGNALS = [
    "don't", "dont", "never", "stop", "wrong", "incorrect", "no,", "no.", "instead", "not that", "already told", "again", "repeat",
    "keep telling", "how many times", "i said", "like i said", "prefer", "always use", "never use", "should always", "should never", "the rule is",
]
WEAK_SIGNALS = [
    "actually", "but", "wrong", "should be", "rather", "better", "correct", "meant", "not what", "supposed to", "change", "different", "fix", "mistake",
]

#: Corrections in a prompt, in order: pattern, group (0: the whole match), type.  Ignore case, dot matches newlines.
CORRECTION_PATTERNS = [
    (r"(?:i (?:already|just) (?:told|said|mentioned|explained)|how many times|stop (?:doing|using)|quit (?:doing|using)|i keep (?:telling|saying|having to))\b[^.!?]*[.!?]?\s*(.{10,300})", 1, "FRUSTRATED_CORRECTION"),
    (r"(?:^|\. )(?:no[,.]?\s+)(?:use|do|try|run|make|set|put|change|switch to)\s+(.{10,200})", 1, "USER_CORRECTION"),
    (r"(?:^|\. )(?:don'?t|do not|never|stop)\s+(?:use|do|try|run|make|set|put|change|add|announce|mention|output|print|show|display|say)\s+(.{10,200})", 1, "USER_CORRECTION"),
    (r"(?:instead of .{5,80}?,?\s*(?:use|do|try|run)\s+.{5,100}|(?:use|do|try|run)\s+.{5,100}\s+instead\b.{0,80})", 0, "USER_CORRECTION"),
    (r"(?:always|never|prefer|i want you to|you should always|you should never|the rule is|the pattern is)\s+(.{10,250})", 1, "USER_PREFERENCE"),
    (r"(?:use|do|run)\s+(\w+)[,.]?\s+not\s+(\w+)", 1, "USER_CORRECTION"),
    (r"(?:again|once more|like i said|as i said|like before|same as before|remember)[,:]?\s+(.{10,200})", 1, "USER_CORRECTION"),
]

#: Decisions in a transcript, in order: pattern (group 1), type.  Ignore case, dot stops at a newline.
DECISION_PATTERNS = [
    (r"(?:decided|chose|chosen|picked|went with|opting for|going with)\s+(.{20,300})", "ARCHITECTURAL_DECISION"),
    (r"(?:the approach is|the design is|architecture:|the plan is)\s+(.{20,300})", "ARCHITECTURAL_DECISION"),
    (r"(?:fix(?:ed)?|resolved|solved|the (?:fix|solution) (?:is|was)|root cause)\s+(.{20,300})", "WORKING_SOLUTION"),
    (r"(?:resolved by|fixed by|the issue was|the problem was)\s+(.{20,300})", "WORKING_SOLUTION"),
    (r"(?:failed|didn't work|broken|bug|error was|doesn't work)\s+(.{20,300})", "FAILED_APPROACH"),
    (r"(?:pattern|approach|technique|method|strategy):\s*(.{20,300})", "CODEBASE_PATTERN"),
    (r"(?:the trick is|the key is|important:)\s+(.{20,300})", "CODEBASE_PATTERN"),
    (r"(?:learned|discovered|found out|realized|turns out)\s+(.{20,300})", "WORKING_SOLUTION"),
    (r"(?:actually,|no,\s+|instead,?|not that,?)\s+(.{20,300})", "USER_PREFERENCE"),
    (r"(?:always|never|prefer|don't want|I want)\s+(.{20,300})", "USER_PREFERENCE"),
    (r"(?:watch out|gotcha|caveat|careful|beware|warning:)\s+(.{20,300})", "FAILED_APPROACH"),
    (r"\[compact\]\s*(.{30,500})", "ARCHITECTURAL_DECISION"),
    (r"(?:Summary of changes|Key changes made|What was done):\s*(.{30,500})", "WORKING_SOLUTION"),
]
VERB_LIKE = "ed|ing|es|s|tion|ment"

#: Reasoning in a plan: a headed section up to the next heading, or a sentence.
PLAN_SECTION = r"(?:#{2,3}\s*(?:Synthesis|Why|Decision|Chose|Rationale).*?\n)((?:.*?\n)*?)(?=#{2,3}\s|\z)"
PLAN_SENTENCES = [r"(?:Chose\s+.+?\s+because\s+.{50,300})", r"(?:Taking\s+.+?\s+from\s+.{50,300})"]

SUMMARY_SKIPPED_TAGS = "stop_hook llm_extracted auto_detected in_session repeated user_correction user_preference auto_extracted session_checkpoint".split()
CHECKPOINT_SKIPPED_TAGS = "stop_hook llm_extracted".split()

#: Sentences of the injected context.
LAST_TITLE = "## Last session"
CORE_TITLE = "## Relevant Knowledge (from past sessions, advisory only — revalidate locally)"
LOG_TITLE = "## Past session learnings\n\nRelevant context from previous sessions:\n"
WARM_TITLE = "## POSSIBLE MATCHES (may be relevant)"
DIRECTIVE = "(Memory is auto-captured in background — no manual action needed.)"
TOPICS_HEAD, SNIPPETS_HEAD = "Last session topics: ", "Last session: "

ERROR_WORDS = "Error error ERROR FAIL Failed Exception Traceback fatal FATAL".split()
TEST_WORDS = ["test", "pytest", "vitest", "jest", "npm run test", "cargo test", "go test"]
PASS_WORDS = ["passed", "ok (", "success", "PASS"]
FAIL_WORDS = ["failed", "FAIL", "error", "ERROR"]
CONFIG_WORDS = "config setup install pip npm apt brew cargo env export chmod systemctl docker ssh".split()
EDIT_TOOLS = "Edit Write MultiEdit".split()
# ---------------------------------------------------------------------------------------------------
