"""Word lists, patterns, weights and sentences of the conversational product search."""

STOPWORDS = (
    "a", "about", "an", "and", "are", "as", "at", "be", "but", "by", "do", "for", "from", "here", "i", "in", "is", "it", "me", "my", "need", "of",
    "on", "or", "please", "some", "that", "the", "this", "to", "want", "what", "with", "would", "you", "your", "looking", "find", "help",
    "matters", "thing", "key", "requirement", "options", "exploring", "prefer", "preference", "prioritize",
)
FIELD_WEIGHTS = {"title": 6.0, "categories": 6.0, "features": 6.0, "details": 3.0, "store": 3.0, "description": 1.0}
MAX_TERMS = 64

# slots of the session memory
COLORS = ("black", "white", "red", "blue", "green", "brown", "pink", "grey", "gray", "yellow")
CATEGORIES = ("shoes", "sneakers", "jacket", "dress", "shirt", "necklace", "ring", "bag", "watch")
MATERIALS = ("leather", "cotton", "wool", "silk", "polyester", "denim", "suede", "canvas", "fabric")
NEGATIONS = ("not", "no", "don't want", "dont want")
TRIGGERS = ("must", "must have", "must be", "needs to be", "has to be", "required", "non-negotiable")
FREE_TEXT = ("feature", "style", "use_case", "brand")
SLOT_ORDER = ("feature", "material", "color", "size", "style", "use_case", "brand", "budget")

# patterns of the intent-aware agent
OVERRIDE = r"\b(?:actually|instead|ignore|changed? my mind|rather)\b"
NO_PREFERENCE = (
    r"(?:not quite right|not suitable|ask me about|do not have|don't have|don.t have|"
    r"no (?:additional |extra )?(?:preference|requirement)|use your judgment|open to suggestions)"
)
MATERIAL_RX = r"\b(?:cotton|polyester|nylon|leather|wool|spandex|silk|rayon|linen|fleece|fabric)\b"
COLOR_RX = r"\b(?:black|white|blue|red|pink|green|brown|gr[ae]y|purple|yellow|orange|beige|navy)\b"
BUDGET_RX = r"(?:\$\s*\d|\b(?:budget|under|below|less than|around \$)\b)"
SIZE_RX = r"\b(?:size|sizing|fit|wide|narrow|small|medium|large|xl|xxl)\b"
STYLE_RX = r"\b(?:style|casual|formal|classic|modern|vintage|sleeve|neckline)\b"
USE_CASE_RX = r"\b(?:hiking|running|gym|winter|outdoor|work|wedding|travel)\b"
DISCLOSURE = r"(?:key requirement is|what matters is|what i need is)\s*:\s*(.+)"
STYLE_TERMS = ("casual", "formal", "classic", "modern", "vintage", "slim fit", "regular fit", "relaxed fit", "crew neck", "v-neck", "long sleeve", "short sleeve")
USE_CASE_TERMS = ("hiking", "running", "gym", "winter", "outdoor", "work", "wedding", "travel", "cycling", "walking", "sports", "swimming", "yoga")
FEATURE_TERMS = (
    "waterproof", "water resistant", "lightweight", "breathable", "moisture wicking", "quick dry", "stretch", "compression", "insulated", "warm",
    "comfortable", "durable", "uv protection", "non slip", "arch support", "padded", "adjustable",
)
QUESTION_ORDER = ("material", "color", "feature", "size", "style", "use_case", "brand", "budget", "other")
PRIORS = {"material": 1.0, "color": 0.92, "feature": 0.95, "size": 0.68, "style": 0.76, "use_case": 0.78, "brand": 0.52, "budget": 0.70}
PROFILE_TAGS = {
    "material": ("material", "comfort", "warmth"), "color": ("color", "style"), "feature": ("comfort", "durability", "weather"), "size": ("fit", "size"),
    "style": ("style",), "use_case": ("weather", "use case"), "brand": ("brand",), "budget": ("budget", "price"),
}
PROMPTS = {
    "material": "Do you have a material preference?", "color": "Is there a color you prefer?", "feature": "Which product feature matters most?",
    "size": "Do you have a size or fit requirement?", "style": "What style are you looking for?", "use_case": "What will you mainly use it for?",
    "brand": "Do you prefer a particular brand?", "budget": "What budget should I stay within?", "other": "Is there another requirement I should prioritize?",
}

# the simulated customer
CARD_MATERIAL = r"\b(cotton|polyester|nylon|leather|wool|spandex|silk|rayon|fabric)\b"
CARD_COLOR = r"\b(black|white|blue|red|pink|green|brown|gray|grey|purple|yellow|orange)\b"
REPLY_WORDS = (
    ("material", ("cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "fabric")),
    ("color", ("color", "black", "white", "blue", "red", "pink", "green")),
    ("size", ("size", "sizing", "width", "wide", "narrow")),
    ("style", ("department", "style", "fit", "sleeve", "neck")),
    ("use_case", ("hiking", "running", "gym", "winter", "outdoor", "work")),
)
GENERIC_CATEGORIES = ("clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry")
NO_CATEGORY = "clothing item"
PARAPHRASES = (
    ("I'm looking for", "Could you recommend"), ("A key requirement is:", "It must have"), (", but I'm still exploring.", "; I am open to suggestions."),
    ("For that, what matters is:", "My preference there is"), ("I don't have an additional preference for", "I have no extra requirement concerning"),
    ("Those options are not quite right yet.", "These are not suitable yet."),
)

# training data
TRAIN_MATERIAL = r"\b(cotton|polyester|nylon|leather|wool|spandex|silk|rayon|linen|fleece|fabric)\b"
TRAIN_COLOR = r"\b(black|white|blue|red|pink|green|brown|gray|grey|purple|yellow|orange|beige|navy)\b"
SCENARIO_CUTS = (("buying", 0.40), ("browsing", 0.80), ("intent_override", 0.95), ("boundary", 1.0))

# reranking
SOFT_WEIGHTS = {"color": 0.04, "material": 0.05, "brand": 0.03, "feature": 0.05, "style": 0.02, "use_case": 0.03, "size": 0.05}
RERANK_FIELDS = {
    "color": ("title", "features", "details", "description"), "material": ("features", "details", "description"), "brand": ("title", "store"),
    "feature": ("features", "details", "description"), "style": ("title", "features", "details", "description"),
    "use_case": ("title", "features", "details", "description"), "size": ("title", "features", "details", "description"),
}
REPLY_LEAD = r"^for that,\s*what matters is:\s*"
