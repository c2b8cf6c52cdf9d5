"""Label texts and category names. Results must carry exactly these."""

# Canonical spellings.
PLATFORMS = ("Meta", "TikTok", "YouTube", "Google")
PRODUCTS = (
    "Whey Protein",
    "Creatine",
    "Pre-Workout",
    "Protein Bars",
    "Resistance Bands",
    "Foam Roller",
    "Dumbbells",
    "Yoga Mat",
)
HOOK_TYPES = ("Question", "Bold Statement", "Story", "Shock", "Tutorial")
CREATIVE_ANGLES = ("Pain Point", "Transformation", "Social Proof", "Educational", "Lifestyle")
COPY_TONES = ("Motivational", "Clinical", "Casual", "Urgent", "Empathetic")
AD_FORMATS = ("Video", "Image", "Carousel", "Story", "Reel")

# Tags in the raw export.
DUPLICATE_TAG = "_dup"
NAME_SUFFIXES = ("_v2", "_test", "_copy")

# Row-level labels.
FATIGUE_STATUS = ("Low Fatigue", "Medium Fatigue", "High Fatigue")
PERFORMANCE_CATEGORIES = (
    "Extreme Winner",
    "Genuine Winner",
    "Break-Even",
    "Illusion",
    "Obvious Loser",
)
LOSS_CATEGORIES = ("Illusion", "Obvious Loser")
PROFIT_STATUS = ("Profitable", "Break-Even", "Loss")

# Decisions.
SCALABILITY = ("Scale", "Monitor", "Optimise", "Kill")
RECOMMENDATION = ("Double Down", "Maintain", "Optimise", "Deprioritise")
SPEND_VERDICTS = ("Spend Justified", "Spend Not Justified")

# Diagnoses.
FUNNEL_DIAGNOSES = (
    "Traffic Problem — low CTR before click",
    "Conversion Problem — low CVR after click",
    "Funnel Healthy",
)
CLICK_TRAP = "Click Trap attracting wrong audience"
FATIGUE_BANDS = (
    "1. Low (0-2)",
    "2. Low-Mid (2-4)",
    "3. Mid (4-6)",
    "4. High (6-8)",
    "5. Critical (8-10)",
)
QUARTER_STATUS = ("Profitable", "Below Breakeven")
MARGIN_HEALTH = ("Danger — Thin Margin", "Moderate — Monitor", "Healthy Margin")
MARGIN_VERDICTS = (
    "Margin Illusion — thin margin warning",
    "Moderate Margin — monitor closely",
    "Healthy Margin",
)
PLATFORM_EFFICIENCY = ("Efficient Platform", "Moderate Platform", "Inefficient Platform")
BREAKEVEN_VERDICTS = (
    "Genuinely Profitable",
    "Barely Breaking Even",
    "Illusion — Losing Money",
    "Obvious Loss",
)
