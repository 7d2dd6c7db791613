"""Fixed values of the reports: patterns, labels, excluded names and default parameters.

Results are only right if these stay exactly as they are.
"""

# Subject of an exam by a pattern in its name; the first match decides.
SUBJECTS = (
    ("%LP%", "Língua Portuguesa"),
    ("%MT%", "Matemática"),
)
SUBJECTS_WITH_MINI_EXAMS = (
    ("%LP%", "Língua Portuguesa"),
    ("%MT%", "Matemática"),
    ("%Minissim%", "Matemática"),
    ("%minisim%", "Língua Portuguesa"),
)
SUBJECTS_WITH_MINI_EXAMS_LISTING = (
    ("%LP%", "Língua Portuguesa"),
    ("%MT%", "Matemática"),
    ("%minisim%", "Língua Portuguesa"),
    ("%Minissim%", "Matemática"),
)

# Course of an exam by a pattern in its name, and the label when none matches.
COURSES = (
    ("%LP C1%", "Língua Portuguesa - Curso 1"),
    ("%MT C1%", "Matemática - Curso 1"),
    ("%LP C2%", "Língua Portuguesa - Curso 2"),
    ("%MT C2%", "Matemática - Curso 2"),
)
OTHER_COURSE = "Outro Curso"

# Exams a report takes in, by patterns in the name.
GENERAL_EXAMS = ("%Sim Geral%", "%Geral%")
SUBJECT_EXAMS = ("%LP%", "%MT%")

# Schools left out: one exact name, or a list compared in lower case.
EXCLUDED_SCHOOL = "Wiquadro"
EXCLUDED_SCHOOLS = ("wiquadro", "teste", "escola demonstração", "escola1", "escola2")

# Default parameters.
PROGRESS_INSTITUTIONS = (335, 336, 363)
LISTING_INSTITUTIONS = (244, 246, 280, 283, 285, 323, 286, 325, 326, 327, 330, 331)
EXAM_INSTITUTIONS = (335, 336, 337, 338, 363, 364)
HIERARCHY_INSTITUTION = 244
MUNICIPALITY = "Tauá"
INSTITUTIONS_2024 = "%2024%"
MUNICIPAL_SCHOOLS = "%Escola Municipal%"
YEAR = 2024
SCOPED_YEAR = 2023
CITY = 2313302
CITY_HOLDING = 159
SCOPE_HOLDING = 157
