"""Phrases and prompt texts, word for word, since prompts must be equal."""

EDUCATION = {
    1: "illiterate",
    2: "with incomplete primary education",
    3: "with complete primary education",
    4: "with incomplete secondary education",
    5: "with complete secondary education",
    6: "with incomplete tertiary education",
    7: "with complete tertiary education",
}
NO_EDUCATION = "with no educational level reported"

# (column, phrase for 1, phrase otherwise)
HISTORY_FLAGS = [
    ("insulin", "using insulin", "not using insulin"),
    ("oraltreatment_dm", "on oral treatment for diabetes", "not on oral treatment for diabetes"),
    ("systemic_hypertension", "with systemic hypertension", "without systemic hypertension"),
    ("alcohol_consumption", "consumes alcohol", "does not consume alcohol"),
    ("smoking", "smokes", "does not smoke"),
    ("obesity", "with obesity", "without obesity"),
    ("vascular_disease", "has vascular disease", "does not have vascular disease"),
    ("acute_myocardial_infarction", "has a history of acute myocardial infarction", "no history of acute myocardial infarction"),
    ("nephropathy", "with nephropathy", "without nephropathy"),
    ("neuropathy", "with neuropathy", "without neuropathy"),
    ("diabetic_foot", "has diabetic foot", "does not have diabetic foot"),
]

# Conditions of the exam prompt, in its order; blanks replace underscores in the text.
PROMPT_CONDITIONS = [
    "macular_edema", "scar", "nevus", "amd", "vascular_occlusion", "hypertensive_retinopathy", "drusens",
    "hemorrhage", "retinal_detachment", "myopic_fundus", "increased_cup_disc", "other",
]

# Conditions of the exam description: (wording, column), in its order.
EXAM_CONDITIONS = [
    ("Conditions include macular edema", "macular_edema"),
    ("scar", "scar"),
    ("nevus", "nevus"),
    ("amd", "amd"),
    ("vascular occlusion", "vascular_occlusion"),
    ("drusens", "drusens"),
    ("hemorrhage", "hemorrhage"),
    ("retinal detachment", "retinal_detachment"),
    ("myopic fundus", "myopic_fundus"),
    ("increased cup disc ratio", "increased_cup_disc"),
    ("and other conditions", "other"),
]

# Columns of the normal / abnormal flag.
NORMALITY_COLUMNS = ["diabetic_retinopathy", *PROMPT_CONDITIONS]

GRADING = """Respond with **yes** if the patient has any level of diabetic retinopathy (ICDR score ≥ 1), or **no** if the score is 0. 
According to the International Clinical Diabetic Retinopathy (ICDR) classification, an eye is considered ICDR 0 when no retinal abnormalities related to diabetic retinopathy are present. ICDR ≥1 indicates the presence of any diabetic retinopathy, defined by the observation of one or more characteristic lesions such as microaneurysms, intraretinal hemorrhages, hard exudates,  venous beading, intraretinal microvascular abnormalities (IRMA), neovascularization, or vitreous/preretinal hemorrhage. Additionally, the presence of panretinal (panphotocoagulation) laser scars is considered evidence of treated proliferative diabetic retinopathy."""

ANSWER_RULE = 'Respond only with "yes" or "no" (without additional commentary).'
RULE_MARK = 'Respond only with "yes" or "no"'

BINARY = f"""{{description}}

Based on the provided patient information and the associated fundus image, does the patient has Diabetic Retinopathy (DR)?

{GRADING}

{ANSWER_RULE}"""

BINARY_IMAGE_ONLY = f"""
Based on the image, does the patient has Diabetic Retinopathy (DR)?

{GRADING}

{ANSWER_RULE}
"""

BINARY_TEXT_ONLY = f"""{{description}}

Based on the provided patient information, does the patient has Diabetic Retinopathy (DR)?

{GRADING}

{ANSWER_RULE}"""

BINARY_TEXT_ONLY_MOBILE = f"""{{description}}

Based on the provided patient information, does the patient have Diabetic Retinopathy (DR)?

{GRADING}

{ANSWER_RULE}"""

FIVE_CLASS = """{description}

Based on the patient information and fundus image, what is the severity grade of Diabetic Retinopathy?

Respond with a single number:
0: No DR
1: Mild NPDR
2: Moderate NPDR
3: Severe NPDR
4: Proliferative DR

Answer only with the number (0-4)."""

THREE_CLASS = """{description}

Based on the patient information and fundus image, classify the Diabetic Retinopathy severity.

Respond with a single number:
0: No DR
1: Non-Proliferative DR (Mild, Moderate, Severe)
2: Proliferative DR

Answer only with the number (0-2)."""

THREE_CLASS_MOBILE = """{description}

Based on the patient information and fundus image, classify the Diabetic Retinopathy (DR) severity into one of the following 3 classes:

0: No DR (ICDR 0)
1: Non-Proliferative DR (ICDR 1-3: Mild, Moderate, Severe)
2: Proliferative DR (ICDR 4)

Respond only with the class number: **0**, **1**, or **2**."""

GLAUCOMA = f"""{{description}}

Based on the patient information and fundus image, does the patient have Glaucoma (or increased cup-disc ratio indicative of glaucoma)?

Respond with **yes** if the patient has glaucoma or increased cup-disc ratio, or **no** otherwise.

{ANSWER_RULE}"""

AMD = f"""Based on the image, does the patient has Age-related Macular Degeneration (AMD)?

Respond with **yes** if the patient has AMD, or **no** otherwise.

{ANSWER_RULE}"""

REFERABLE = f"""{{description}}

Based on the provided patient information and the associated fundus image, does the patient has Referable Diabetic Retinopathy?

Respond with **yes** if the patient has referable diabetic retinopathy (Moderate NPDR or worse, ICDR score ≥ 2, or presence of Diabetic Macular Edema), or **no** otherwise.

{ANSWER_RULE}"""

REFERABLE_MOBILE = f"""{{description}}

Based on the provided patient information and the associated fundus image, does the patient has Referable Diabetic Retinopathy?

Respond with **yes** if the patient has moderate or worse diabetic retinopathy (ICDR score ≥ 2) or diabetic macular edema, or **no** otherwise.

{ANSWER_RULE}"""

STEPS_BINARY = """Let's think step by step to determine the presence of Diabetic Retinopathy. Analyze the patient's clinical features and the fundus image details.
Finally, provide your answer as "Answer: yes" or "Answer: no"."""

STEPS_REFERABLE = """Let's think step by step to determine if the Diabetic Retinopathy is referable. Consider the severity levels and presence of edema.
Finally, provide your answer as "Answer: yes" or "Answer: no"."""

REASON_FIRST = """Please reason about the diagnosis first, then provide your final answer in the exact format "Answer: yes" or "Answer: no"."""

ROLE = "You are an expert ophthalmologist specialized in diagnosing retinal diseases from fundus images and clinical metadata."

TASK_HEADER = "Task: Answer the following question based on the image.\n"
SINGLE_LABEL = "This is a single-label task. Choose exactly one of the following classes: "
MULTI_LABEL = "This is a multilabel task. Possible classes are: "
CLASS_MEANINGS = {
    "fakeddit": "0 (Fake) or 1 (Real)",
    "brset": "0 (No Diabetic Retinopathy) or 1 (Diabetic Retinopathy)",
    "mbrset": "0 (No Diabetic Retinopathy) or 1 (Diabetic Retinopathy)",
}

# Wrappers of models that give one vector for image and text.
QUESTION_WRAPPER = ("Question: ", " Answer:")
CHAT_WRAPPER = ("<image>\nUSER: ", "\nASSISTANT:")

# Base prompts: (dataset, task, text). "brset" exams carry anatomy and conditions,
# "mbrset" exams carry the patient's history.
BASE_PROMPTS = [
    ("brset", "binary_dr", BINARY),
    ("mbrset", "binary_dr", BINARY),
    ("brset", "referable_dr", REFERABLE),
    ("mbrset", "referable_dr", REFERABLE_MOBILE),
    ("brset", "5_class_dr", FIVE_CLASS),
    ("mbrset", "5_class_dr", FIVE_CLASS),
    ("brset", "3_class_dr", THREE_CLASS),
    ("mbrset", "3_class_dr", THREE_CLASS_MOBILE),
    ("brset", "glaucoma", GLAUCOMA),
    ("mbrset", "glaucoma", GLAUCOMA),
    ("brset", "amd", AMD),
]

# Prompts outside the dispatch table, by (dataset, modality).
SINGLE_MODALITY_PROMPTS = [
    ("brset", "image_only", BINARY_IMAGE_ONLY),
    ("mbrset", "image_only", BINARY_IMAGE_ONLY),
    ("brset", "text_only", BINARY_TEXT_ONLY),
    ("mbrset", "text_only", BINARY_TEXT_ONLY_MOBILE),
]

# Tasks that know each strategy besides "base".
STRATEGY_TASKS = {
    "cot": ["binary_dr", "referable_dr"],
    "role": ["binary_dr", "referable_dr"],
    "base_grpo": ["binary_dr", "referable_dr", "glaucoma"],
    "role_grpo": ["binary_dr", "referable_dr", "glaucoma"],
}
