"""Word lists and patterns. All are fixed values that results depend on."""

CATEGORY_KEYWORDS = {
    "skincare": ["skincare", "skin care", "serum", "moisturizer", "cleanser", "toner", "sunscreen", "spf", "retinol", "niacinamide", "hyaluronic acid", "vitamin c", "glycolic acid", "salicylic acid", "barrier repair", "double cleanse", "glass skin", "dewy skin", "skin cycling"],
    "makeup": ["makeup", "foundation", "concealer", "mascara", "eyeliner", "lipstick", "eyeshadow", "blush", "highlighter", "contour", "bronzer", "primer", "setting spray", "lip gloss", "lip tint", "brow gel"],
    "beauty": ["beauty", "glow", "radiant", "aesthetic", "selfcare", "self care", "routine", "transformation", "grwm", "get ready", "before after"],
    "fashion": ["fashion", "style", "outfit", "ootd", "fashion week", "trends", "chic", "elegant", "stylish", "wardrobe", "accessories"],
    "hair": ["hair", "shampoo", "conditioner", "hair mask", "hair oil", "scalp care", "hair growth", "keratin", "heat protectant"],
}

VOCABULARY_KEYWORDS = ["skincare", "makeup", "foundation", "concealer", "lipstick", "mascara", "eyeshadow", "blush", "bronzer", "primer", "serum", "moisturizer", "cleanser", "toner", "sunscreen", "retinol", "hyaluronic", "vitamin", "beauty", "cosmetics", "routine", "tutorial", "review", "haul"]

STOP_WORDS = """
the a an and or but in on at to for of with by from up about into through during before after above below between among
is was are were be been being have has had do does did will would could should may might must can this that these those
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom whose where when why how all any both each few more most other some
such no nor not only own same so than too very
""".split()

RULE_CATEGORIES = {
    "skincare": ["skin", "skincare", "serum", "moisturizer", "cleanser", "spf", "sunscreen", "retinol", "niacinamide", "hyaluronic", "vitamin c", "acne", "wrinkle"],
    "makeup": ["makeup", "foundation", "concealer", "mascara", "lipstick", "eyeshadow", "blush", "highlighter", "contour", "bronzer", "primer"],
    "hair": ["hair", "shampoo", "conditioner", "styling", "scalp", "hair care", "keratin"],
    "fashion": ["fashion", "style", "outfit", "clothing", "dress", "shoes", "accessories"],
    "lifestyle": ["lifestyle", "life", "daily", "routine", "wellness", "health"],
}

POSITIVE = ["love", "amazing", "great", "awesome", "fantastic", "excellent", "perfect", "beautiful", "gorgeous", "stunning", "wonderful", "incredible", "best", "favorite", "obsessed", "recommend", "holy grail"]
NEGATIVE = ["hate", "terrible", "awful", "horrible", "worst", "bad", "disappointed", "annoying", "irritating", "useless", "waste", "regret", "broke out"]

AGE_CASCADE = [
    ("gen_z", 0.8, ["gen z", "generation z", "zoomer"]),
    ("teen", 0.9, ["teen", "teenager"]),
    ("young_adult", 0.7, ["college", "university", "student"]),
    ("millennial", 0.8, ["millennial", "gen y"]),
    ("gen_x", 0.8, ["gen x", "generation x"]),
    ("boomer", 0.8, ["boomer", "baby boomer"]),
]
AGE_LIMITS = [(17, "teen"), (26, "gen_z"), (42, "millennial"), (57, "gen_x")]

SPELLING = {
    "perfune": "perfume", "maskara": "mascara", "foundaton": "foundation", "contouring": "contouring", "highliter": "highlighter",
    "blending": "blending", "moisturiser": "moisturizer", "cleanser": "cleanser", "exfoliant": "exfoliant", "serium": "serum",
    "retinol": "retinol", "niacinamide": "niacinamide", "hyaluronic": "hyaluronic", "glycolic": "glycolic", "salicylic": "salicylic",
    "vitaminc": "vitamin c", "spf": "spf", "sunscreen": "sunscreen", "skincare": "skincare", "haircare": "hair care",
    "shampoo": "shampoo", "conditioner": "conditioner", "styling": "styling", "hairmask": "hair mask", "lipstick": "lipstick",
    "lipgloss": "lip gloss", "eyeliner": "eyeliner", "eyeshadow": "eyeshadow", "bronzer": "bronzer", "concealer": "concealer",
    "primer": "primer", "blush": "blush", "rouge": "blush", "polish": "nail polish", "manicure": "manicure", "pedicure": "pedicure",
}

# Character classes that Java and RE2 read alike.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
MENTION = rf"@[{WORD}]+"
SPECIAL = rf"[^{WORD}{SPACE}#]"
GAP = rf"[{SPACE}]+"
# What a cleaned text has a blank for, in two passes: an emoji ends an address or a name as a blank does.
_EMOJI = EMOJI[1:-2]
ADDRESS = rf"(?:https?://|www\.)[^{SPACE}{_EMOJI}]+"
NOISE = rf"@[{WORD}&&[^{_EMOJI}]]*|[[{_EMOJI}][^{WORD}#@]]+"
HASHTAG = rf"#([{WORD}]+)"
TERM_NOISE = rf"http[^{SPACE}]+|@[{WORD}]+|#[{WORD}]+"
TERM_SPECIAL = rf"[^{WORD}{SPACE}]"
TERM_TOKEN = rf"[{WORD}]{{2,}}"
AGE_PATTERNS = (
    r"\b(\d{1,2})\s*(years?\s*old|yo|y\.o\.)\b",
    r"\bage\s*(\d{1,2})\b",
    r"\b(gen\s*z|generation\s*z|zoomer)\b",
    r"\b(millennial|gen\s*y|generation\s*y)\b",
    r"\b(gen\s*x|generation\s*x)\b",
    r"\b(boomer|baby\s*boomer)\b",
    r"\b(teen|teenager|teenage)\b",
    r"\b(college|university|student)\b",
    r"\b(young\s*adult|twenty\s*something)\b",
    r"\b(middle\s*aged|mid\s*life)\b",
)
AGES = (r"\b(\d{1,2})\s*(?:years?\s*old|yo|y\.o\.)\b", r"\bage\s*(\d{1,2})\b")
