"""Fixed values of the label space.

Everything in this module is a constant that has to equal the published value
for results to match. Long texts (definitions, glossary, hint sentences, prompt
bodies) and the large mined hint tables are data: read them with
``changelens.sources.dimensions`` or mine them with ``changelens.operators.rules``.
"""

# The 39 labels by level.
PARAMETER_LEVEL = [
    "Add Parameter", "Remove Parameter", "Rename Parameter", "Reorder Parameter",
    "Split Parameter", "Localize Parameter", "Parameterize Variable",
    "Parameterize Attribute", "Change Variable Type",
]
METHOD_LEVEL = [
    "Extract Method", "Extract And Move Method", "Inline Method", "Move Method",
    "Move And Rename Method", "Rename Method", "Rename Variable", "Rename Attribute",
    "Extract Variable", "Inline Variable", "Replace Variable With Attribute",
    "Replace Attribute With Variable", "Split Conditional", "Invert Condition",
    "Move Code",
]
CLASS_LEVEL = [
    "Move Class", "Rename Class", "Move And Rename Class", "Extract Class",
    "Extract Subclass", "Extract Superclass", "Move Attribute", "Pull Up Method",
    "Push Down Method", "Pull Up Attribute", "Push Down Attribute",
    "Encapsulate Attribute", "Add Method Annotation", "Remove Method Annotation",
    "Add Class Annotation",
]
LEVELS = {
    "parameter_level": PARAMETER_LEVEL,
    "method_level": METHOD_LEVEL,
    "class_level": CLASS_LEVEL,
}
KNOWN_TYPES = PARAMETER_LEVEL + METHOD_LEVEL + CLASS_LEVEL

# Curated co-occurrence hints, label -> ordered partners.
CURATED_HINTS = {
    "Add Class Annotation": ["Remove Method Annotation", "Move Method", "Extract Class"],
    "Add Method Annotation": ["Remove Method Annotation", "Rename Method", "Extract Variable"],
    "Add Parameter": ["Remove Parameter", "Rename Variable", "Rename Parameter"],
    "Change Variable Type": ["Rename Variable", "Extract Variable", "Add Parameter"],
    "Encapsulate Attribute": ["Move And Rename Method", "Rename Variable", "Rename Method"],
    "Extract And Move Method": ["Parameterize Variable", "Inline Variable", "Rename Variable"],
    "Extract Class": ["Move Method", "Move Attribute", "Add Parameter"],
    "Extract Method": ["Rename Variable", "Rename Parameter", "Remove Parameter"],
    "Extract Subclass": ["Push Down Method", "Push Down Attribute", "Remove Parameter"],
    "Extract Superclass": ["Pull Up Method", "Pull Up Attribute", "Move Code"],
    "Extract Variable": ["Rename Variable", "Add Parameter", "Extract Method"],
    "Inline Method": ["Rename Variable", "Inline Variable", "Rename Parameter"],
    "Inline Variable": ["Rename Variable", "Extract Method", "Extract Variable"],
    "Invert Condition": ["Extract Variable", "Rename Variable", "Extract Method"],
    "Localize Parameter": ["Add Parameter", "Remove Parameter", "Rename Parameter"],
    "Move And Rename Class": ["Move Class", "Rename Method", "Move Method"],
    "Move And Rename Method": ["Remove Parameter", "Rename Variable", "Rename Parameter"],
    "Move Attribute": ["Move Method", "Extract Class", "Add Parameter"],
    "Move Class": ["Rename Method", "Move And Rename Class", "Extract Class"],
    "Move Code": ["Move Attribute", "Move Method", "Extract Class"],
    "Move Method": ["Move Attribute", "Add Parameter", "Remove Parameter"],
    "Parameterize Attribute": ["Add Parameter", "Remove Parameter", "Rename Variable"],
    "Parameterize Variable": ["Add Parameter", "Remove Parameter", "Rename Variable"],
    "Pull Up Attribute": ["Extract Superclass", "Pull Up Method", "Inline Variable"],
    "Pull Up Method": ["Extract Superclass", "Pull Up Attribute", "Inline Variable"],
    "Push Down Attribute": ["Push Down Method", "Extract Subclass", "Rename Class"],
    "Push Down Method": ["Extract Subclass", "Push Down Attribute", "Add Parameter"],
    "Remove Method Annotation": ["Add Method Annotation", "Extract Variable", "Remove Parameter"],
    "Remove Parameter": ["Add Parameter", "Rename Parameter", "Rename Method"],
    "Rename Attribute": ["Rename Method", "Add Parameter", "Rename Variable"],
    "Rename Class": ["Remove Parameter", "Rename Parameter", "Move Method"],
    "Rename Method": ["Remove Parameter", "Add Parameter", "Rename Variable"],
    "Rename Parameter": ["Remove Parameter", "Rename Variable", "Add Parameter"],
    "Rename Variable": ["Add Parameter", "Extract Variable", "Rename Parameter"],
    "Reorder Parameter": ["Add Parameter", "Remove Parameter", "Rename Method"],
    "Replace Attribute With Variable": [
        "Extract Variable", "Inline Variable", "Replace Variable With Attribute"],
    "Replace Variable With Attribute": ["Remove Parameter", "Rename Variable", "Extract Method"],
    "Split Conditional": ["Extract Method", "Add Parameter"],
    "Split Parameter": ["Add Parameter", "Rename Parameter", "Extract Variable"],
}

# Labels always offered as backup candidates, in order.
ALWAYS_CHECK = [
    "Invert Condition", "Split Conditional", "Extract Subclass", "Extract Superclass",
    "Encapsulate Attribute", "Move And Rename Method", "Move And Rename Class",
    "Extract And Move Method",
]

# Labels that own a confusion hint; the compounds and their triggers.
CONFUSABLE = [
    "Add Parameter", "Remove Parameter", "Rename Variable", "Rename Attribute",
    "Rename Parameter", "Split Conditional", "Extract Method", "Inline Variable",
    "Extract Variable", "Move Method", "Move Class", "Move And Rename Method",
    "Move And Rename Class", "Extract And Move Method", "Extract Subclass",
    "Extract Superclass", "Invert Condition", "Pull Up Method", "Push Down Method",
]
COMPOUNDS = ["Move And Rename Method", "Move And Rename Class", "Extract And Move Method"]
COMPOUND_TRIGGERS = [
    "Move Method", "Rename Method", "Move Class", "Rename Class", "Extract Method",
    "Move Code",
]
OFTEN_MISSED = ["Extract Subclass", "Extract Superclass", "Invert Condition"]
COMPOUND_PARTS = {
    "Move And Rename Method": ["Move Method", "Rename Method"],
    "Move And Rename Class": ["Move Class", "Rename Class"],
    "Extract And Move Method": ["Extract Method", "Move Method"],
}

# Evidence gates.
CLASS_GATED = [
    "Extract Class", "Extract Subclass", "Extract Superclass", "Move Class",
    "Rename Class", "Move And Rename Class", "Pull Up Method", "Pull Up Attribute",
    "Push Down Method", "Push Down Attribute",
]
SIGNAL_GATE = {
    "Rename Variable": "rename", "Rename Parameter": "rename", "Rename Attribute": "rename",
    "Replace Variable With Attribute": "swap", "Replace Attribute With Variable": "swap",
    "Invert Condition": "invert", "Split Conditional": "split",
    "Change Variable Type": "type_change", "Extract Variable": "extract",
    "Inline Variable": "inline",
}
TWO_STEP_GATE = {
    "Extract And Move Method": ["moved", "added"],
    "Move And Rename Class": ["moved", "renamed"],
    "Move And Inline Method": ["moved", "removed"],
    "Move And Rename Method": ["moved", "renamed"],
}

# Names that never count as renamed identifiers.
NOISE_NAMES = [
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class",
    "continue", "def", "del", "elif", "else", "except", "finally", "for", "from",
    "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass",
    "raise", "return", "try", "while", "with", "yield", "self", "cls",
    "print", "len", "range", "list", "dict", "set", "tuple", "str", "int", "float",
    "bool", "abs", "all", "any", "min", "max", "sum", "sorted", "reversed", "enumerate",
    "zip", "map", "filter", "isinstance", "type", "open", "input", "format", "repr",
    "hash", "id", "iter", "next", "vars", "dir", "callable", "getattr", "setattr",
    "hasattr",
]

# Comparator pairs, tried in this order.
COMPARATOR_FLIPS = [
    ("==", "!="), ("!=", "=="), ("<", ">="), (">=", "<"), (">", "<="), ("<=", ">"),
    ("is", "is not"), ("is not", "is"), (" in ", " not in "), (" not in ", " in "),
]

# Similarity thresholds and fusion weights.
FILE_SIMILARITY = 0.55
CODE_SIMILARITY = 0.65
FUSION_WEIGHTS = (0.345, 0.609, 0.046)


def level_of(label: str) -> str | None:
    return next((lv for lv, names in LEVELS.items() if label in names), None)
