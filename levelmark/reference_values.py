"""Fixed values of the tagging task: sectors, level chart, prompt texts."""

from pyspark.sql import DataFrame, SparkSession

# Sector code -> sector name.
SECTORS = {
    "HR": "Human Resource",
    "FOOD": "Food",
    "FIN": "Financial",
    "FM": "Food Manufacturing",
    "AIR": "Air Transport",
    "BIO": "BioPharmaceuticals Manufacturing",
    "BUILT": "Built Environment",
    "EC": "Energy and Chemicals",
    "ENG": "Engineering",
    "ENV": "Environmental",
    "HC": "Healthcare",
    "LOG": "Logistics",
    "MAR": "Marine and Offshore",
    "PUB": "Public Transport",
    "SEA": "Sea Transport",
    "SEC": "Security",
    "SOC": "Social Service",
    "WATER": "Water Management",
    "TRADE": "Wholesale Trade",
    "DSGN": "Design",
}

# What each generic level expects
# (level, responsibility, autonomy, complexity, knowledge and ability).
LEVEL_CHART = [
    (
        1,
        ["Work under direct supervision.", "Accountable for tasks assigned."],
        ["Minimal discretion required. Expected to seek guidance."],
        ["Required to perform mainly routine work."],
        [
            "Able to recall factual and procedural knowledge.",
            "Apply basic skills to carry out defined tasks.",
            "Identify opportunities for minor adjustments to work tasks.",
        ],
    ),
    (
        2,
        ["Work with some supervision.", "Accountable for a broader set of tasks assigned."],
        [
            "Use limited discretion in resolving issues or enquiries.",
            "Able to work independently without frequently looking to others for guidance.",
        ],
        ["Required to perform mainly routine work."],
        [
            "Able to understand and apply factual and procedural knowledge in a field of work.",
            "Apply basic cognitive and technical skills to carry out defined tasks and solve routine problems using simple procedures and tools.",
            "Able to present ideas and improve work.",
        ],
    ),
    (
        3,
        [
            "Work under broad direction.",
            "May hold some accountability for performance of others, in addition to self.",
        ],
        [
            "Use discretion in identifying and responding to issues, work with others and contribute to work performance."
        ],
        ["Required to perform less routine, more complex work."],
        [
            "Able to apply relevant procedural and conceptual knowledge, and skills to perform differentiated work activities and manage changes.",
            "Able to collaborate with others to identify value-adding opportunities.",
        ],
    ),
    (
        4,
        ["Work under broad direction.", "Hold accountability for performance of self and others."],
        ["Exercise judgment; Adapt and influence to achieve work performance."],
        ["Required to perform less routine, more complex work."],
        [
            "Able to evaluate and develop factual and conceptual knowledge within a field of work.",
            "Able to select and apply a range of cognitive and technical skills to solve non-routine, less well-defined or abstract problems.",
            "Able to manage work activities which may be unpredictable.",
            "Facilitate the implementation of innovation.",
        ],
    ),
    (
        5,
        ["Accountable for achieving assigned objectives, decisions made by self and others."],
        ["Provide leadership to achieve desired work results; Manage resources, set milestones and drive work."],
        ["Required to perform complex work."],
        [
            "Able to evaluate factual and advanced conceptual knowledge within a field of work, involving critical understanding of theories and principles.",
            "Able to select and apply an advanced range of cognitive and technical skills, demonstrating mastery and innovation, to devise solutions to solve complex and unpredictable problems in a specialised field of work.",
            "Able to manage and drive complex work activities.",
        ],
    ),
    (
        6,
        ["Accountable for significant area of work, strategy or overall direction."],
        [
            "Empower to chart direction and practices within and outside of work (including professional field / community), to achieve / exceed work results."
        ],
        ["Required to perform complex work."],
        [
            "Able to synthesise knowledge issues in a field of work and be the interface between different fields, in order to create new forms of knowledge.",
            "Employ advanced skills, to solve critical problems and formulate new structures, and/or to redefine existing knowledge or professional practices.",
            "Demonstrate exemplary ability to innovate, and formulate ideas and structures.",
        ],
    ),
]
LEVEL_CHART_FIELDS = ["responsibility", "autonomy", "complexity", "knowledge_and_ability"]

# Pieces of the two user messages, in order; the values named
# in the comments go between them.
ROUND1_MESSAGE = [
    'Determine the appropriate proficency level for skill: "',  # skill title
    "\", based on how it's taught in the following description of a course: ",  # course title
    ", Course Description: ",  # about
    " Course Learning Objectives: ",  # learn
    ". And how its proficiency levels are defined: ",  # level block
    ".",
]
ROUND2_MESSAGE = [
    "For the training course “",  # course text
    "”, what is the most appropriate proficiency level to be tagged to the skill “",  # skill title
    "”, based on the Knowledge Base ",  # knowledge base
    "? Only if you need more info, refer to the Reference Document ",  # level chart
    ". Reply in JSON as {'proficiency':<>, 'reason':<>, 'confidence':<high|medium|low>}.",
]

# Default system messages; both are parameters of the scorer.
ROUND1_SYSTEM = (
    "You match skills taught in courses to proficiency levels. Read the course, the skill and the "
    "definition of each level, then choose one of the defined levels, or 0 when none fits or you are "
    "not sure. Explain the choice in under 30 words and rate your confidence low, medium or high. "
    'Answer with one JSON object only: {"proficiency_level": integer, "reason": text, '
    '"confidence": "low / medium / high"}.'
)
ROUND2_SYSTEM = (
    "You tag skills taught in training courses with proficiency levels. Use the Knowledge Base first and "
    "the Reference Document only where you need more. Choose a level listed in the Knowledge Base for the "
    "skill, or 0 when not sure. Answer with one JSON object only: "
    '{"proficiency": integer, "reason": text, "confidence": "high|medium|low"}.'
)

# Separators of the course text and of joined items.
TITLE_SEPARATOR = " |: "
ABOUT_SEPARATOR = " | "
ITEM_SEPARATOR = ", "

# Titles of the three published results, by bucket.
RESULT_TITLES = {
    "valid": "Valid Skills for %s sector",
    "invalid": "Invalid Skills for %s",
    "all_tagged": "All Tagged Skills for %s sector",
}


def sector_dimension(spark: SparkSession) -> DataFrame:
    """20 rows, fixed: position, alias, full name and picker label."""
    rows = [(i, alias, name, f"{alias} ({name})") for i, (alias, name) in enumerate(SECTORS.items(), 1)]
    return spark.createDataFrame(rows, "position int, alias string, full_name string, label string")


def level_chart(spark: SparkSession) -> DataFrame:
    """6 rows, fixed: one per generic level, four lists of text each."""
    fields = ", ".join(f"{name} array<string>" for name in LEVEL_CHART_FIELDS)
    return spark.createDataFrame(LEVEL_CHART, f"level int, {fields}")
