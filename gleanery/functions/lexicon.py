"""Word lists and patterns of the text rules. Results depend on each of them."""

NEGATION = [
    "not", "never", "no", "don't", "doesn't", "didn't", "can't", "couldn't", "isn't", "wasn't", "aren't", "weren't",
    "won't", "wouldn't", "nothing", "nobody", "nowhere",
]
BAD_AFTER_NEGATION = [
    "bad", "awful", "terrible", "horrible", "boring", "broken", "disappointed", "disappointing", "wrong", "useless", "impossible",
    "worst", "poor", "weak", "dull",
]
CONTRASTIVE = ["but", "however", "although", "though", "despite"]
STRONG_NEGATIVE = [
    "bs", "garbage", "trash", "shit", "crap", "suck", "sucks", "sucked", "cheaters", "cheater", "cheating", "cheats", "stupid", "cancer", "toxic",
]
SLANG = [
    "fr", "no cap", "slaps", "mid", "ngl", "based", "cringe", "goat", "goated", "ez", "sus", "gg", "banger", "cooked", "washed",
    "cope", "bussin", "dogwater", "gigachad", "sweaty",
]
BUG_CRASH = [
    "bug", "bugs", "buggy", "crash", "crashes", "crashing", "crashed", "glitch", "glitches", "glitchy", "freeze", "freezes", "freezing", "froze",
    "lag", "laggy", "unplayable", "broken", "unstable", "error", "errors",
]
DEV_CRITICISM = [
    "greedy", "cash grab", "cashgrab", "money grab", "abandoned", "milking", "dead game", "no support", "anti-consumer", "anti consumer", "scummy",
    "lazy devs", "soulless", "cash cow",
]
DLC_MONETIZATION = [
    "dlc", "season pass", "microtransaction", "microtransactions", "paywall", "cut content", "day one dlc", "day-one dlc", "complete edition",
    "definitive edition", "should be free", "behind a paywall", "overpriced",
]
RATING_SYMBOL = [r"\b0/10\b", r"\b10/10\b", "★", r"\b100%\b", r"\b1/10\b", r"\b9/10\b"]
CONDITIONAL = [r"\b(would|could|should|might)\s+have\s+been\b", r"\bif only\b", r"\b(would|could)\s+be\b[^.!?]{0,40}\bif\b", r"\bwould have\b", r"\bcould have\b"]
SARCASM_MARKER = [
    r'"\s*(great|amazing|good|best|fun|wonderful|perfect|fantastic|brilliant|masterpiece)\s*"',
    r"/s\b",
    r"\boh\s+(great|wonderful|joy|boy|yeah)\b",
    r"\byeah\s+right\b",
    r"\bwhat a (surprise|shocker)\b",
]
TEMPORAL_SHIFT = [r"\bused to\b", r"\buntil (the |an |a )?(update|patch|dlc|expansion)\b", r"\bno longer\b", r"\bever since\b", r"\bnowadays\b", r"\bthese days\b", r"\bback (then|in the day)\b"]
#: Code point ranges of emoji, in a spelling that Java and RE2 share.
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}]"
EMOTICON = r"[:;=8][-o^']?[)(\]\[DPpoO3<>|]|</?3|(^|[^A-Za-z])[xX]D([^A-Za-z]|$)|\^[_.]?\^|[oO][_.][oO]|[tT]_[tT]|;_;|>:[()]"

#: Order in which a text's tags are listed.
TAGS = [
    "negation", "double_negation", "contrastive", "strong_negative", "rating_symbol", "slang", "emoticon", "conditional", "sarcasm_marker",
    "temporal_shift", "bug_crash", "dev_criticism", "dlc_monetization", "all_caps", "short_text", "long_text",
]
#: Order in which reports list them.
REPORT_ORDER = [
    "negation", "double_negation", "contrastive", "conditional", "sarcasm_marker", "temporal_shift", "strong_negative", "bug_crash", "dev_criticism",
    "dlc_monetization", "rating_symbol", "slang", "emoticon", "all_caps", "short_text", "long_text",
]

STOPWORDS = (
    "i a an the and or but if so to of in on at for with as by is are was were be been being have has had do does did will would should "
    "could can may might must this that these those my your his her its our their me you him us them we he she it they what which who when "
    "where why how all each every some any no not only own same than then too very just one two there here"
).split()
CONTRACTION_FRAGMENTS = "s t d m ll ve re don won isn wasn aren weren doesn didn couldn wouldn shouldn hasn haven hadn mustn mightn needn ain shan".split()

TRAINING_GAMES = [1086940, 1091500, 413150, 292030, 271590, 730, 570]
NOISE_GENRES = ["Indie", "Free To Play", "Early Access"]
NOISE_TAGS = ["Singleplayer", "Great Soundtrack", "Atmospheric", "Surreal", "Free to Play", "Indie", "Early Access"]
