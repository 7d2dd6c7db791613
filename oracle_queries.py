"""DuckDB texts of the registered queries: plain joins and distinct counts over
the same tables, written without the reductions the Spark side makes.

Rates and means are rounded in whole numbers, as DuckDB divides decimals in
binary floating point.
"""

from __future__ import annotations

from boletim.functions.fixed_values import EXCLUDED_SCHOOLS

_TABLES = {
    "holdings": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region",
    "cities": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region",
    "regions": "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS city_id FROM nation",
    "institutions": """
        SELECT CAST(n_nationkey AS BIGINT) AS id,
               n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' - 2024' ELSE ' - 2023' END AS name,
               CAST(n_regionkey AS BIGINT) AS holding_id
        FROM nation""",
    "institution_colleges": """
        SELECT s_suppkey AS id,
               CASE WHEN s_suppkey % 20 = 8 THEN 'Wiquadro'
                    WHEN s_suppkey % 20 = 9 THEN 'TESTE'
                    WHEN s_suppkey % 3 = 0 THEN 'ESCOLA MUNICIPAL ' || s_name
                    ELSE s_name END AS name,
               CAST(s_nationkey AS BIGINT) AS institution_id,
               CAST(2023 + s_suppkey % 2 AS INTEGER) AS year,
               CAST(s_nationkey AS BIGINT) AS region_id
        FROM supplier""",
    "institution_courses": """
        SELECT id * 2 + k AS id, 'Curso ' || CAST(k + 1 AS VARCHAR) AS name,
               CASE WHEN id % 7 = 3 THEN id - 1 ELSE id END AS institution_college_id
        FROM (SELECT id, unnest([0, 1]) AS k FROM institution_colleges)""",
    "institution_levels": """
        SELECT id * 2 + k AS id, CAST(k + 1 AS VARCHAR) || 'º ano' AS name,
               CASE WHEN id % 11 = 5 THEN id - 1 ELSE id END AS course_id
        FROM (SELECT id, unnest([0, 1]) AS k FROM institution_courses)""",
    "institution_classrooms": """
        SELECT id * 2 + k AS id, CASE WHEN k = 0 THEN 'Turma A' ELSE 'Turma B' END AS name, id AS level_id
        FROM (SELECT id, unnest([0, 1]) AS k FROM institution_levels)""",
    "users": "SELECT c_custkey AS id FROM customer",
    "institution_enrollments": """
        SELECT user_id, classroom_id, college_id,
               CAST(s_nationkey AS BIGINT) AS institution_id, CAST(n_regionkey AS BIGINT) AS holding_id
        FROM (SELECT o_custkey AS user_id,
                     (o_custkey % (SELECT count(*) FROM supplier)) * 8 + o_orderkey % 8 AS classroom_id,
                     (o_custkey + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END)
                         % (SELECT count(*) FROM supplier) AS college_id
              FROM orders) placed
        JOIN supplier ON s_suppkey = college_id
        JOIN nation ON n_nationkey = s_nationkey""",
    "quizzes": """
        SELECT p_partkey AS id,
               p_brand || [' LP C1', ' MT C1', ' LP C2', ' MT C2', ' Sim Geral LP', ' Sim Geral MT',
                           ' Minissim', ' minisim', ' Geral'][p_partkey % 9 + 1] AS name
        FROM part""",
    "quiz_user_progresses": """
        SELECT o_custkey AS user_id, l_partkey AS quiz_id, l_linestatus = 'F' AND o_custkey % 10 <> 4 AS finished
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "quiz_grades": """
        SELECT o_custkey AS user_id, l_partkey AS quiz_id, CAST(max(l_quantity) AS DECIMAL(5, 1)) AS average
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""",
    "institutions_quizzes": """
        SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS institution_id, l_partkey AS quiz_id
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""",
    "institutions_learning_modules": """
        SELECT CAST(n_nationkey AS BIGINT) AS institution_id, CAST(n_nationkey % 7 AS BIGINT) AS learning_module_id
        FROM nation""",
    "learning_module_quizzes": """
        SELECT p_partkey % 35 AS learning_module_id, p_partkey AS quiz_id FROM part""",
}

# Shared by the reports: a row per complete classroom chain, and per finished attempt of a known
# student in a known exam.
_SHARED = {
    "chain": """
        SELECT c.id AS classroom_id, c.name AS classroom, l.name AS level, e.id AS college_id, e.name AS college,
               e.year, e.region_id, i.id AS institution_id, i.name AS institution
        FROM institution_classrooms c
        JOIN institution_levels l ON l.id = c.level_id
        JOIN institution_courses k ON k.id = l.course_id
        JOIN institution_colleges e ON e.id = k.institution_college_id
        JOIN institutions i ON i.id = e.institution_id""",
    "chain_city": """
        SELECT chain.*, cities.id AS city_id, cities.name AS city
        FROM chain JOIN regions r ON r.id = chain.region_id JOIN cities ON cities.id = r.city_id""",
    "finished": """
        SELECT p.user_id, p.quiz_id, q.name AS exam
        FROM quiz_user_progresses p JOIN users ON users.id = p.user_id JOIN quizzes q ON q.id = p.quiz_id
        WHERE p.finished""",
}

_INSTITUTIONS = "(0, 2, 4, 6, 8, 10, 12, 14)"
_EXCLUDED = "(" + ", ".join(f"'{name.lower()}'" for name in EXCLUDED_SCHOOLS) + ")"


def _with(steps: dict[str, str], final: str) -> str:
    """Complete text over the report tables, which ``texts`` puts in front."""
    body = ",\n".join(f"{name} AS ({text})" for name, text in {**_SHARED, **steps}.items())
    return f"{body}\n{final}"


def _percent(part: str, total: str, digits: int) -> str:
    unit = 10**digits
    whole = f"greatest({total}, 1)"
    return f"CAST((2 * {100 * unit} * coalesce({part}, 0) + {whole}) // (2 * {whole}) AS DOUBLE) / {unit}"


_SUBJECT = """CASE WHEN contains(exam, 'LP') THEN 'Língua Portuguesa'
    WHEN contains(exam, 'MT') THEN 'Matemática' {rest} END"""
_MINI = """WHEN contains(exam, 'Minissim') THEN 'Matemática'
    WHEN contains(exam, 'minisim') THEN 'Língua Portuguesa'"""
_MINI_LISTING = """WHEN contains(exam, 'minisim') THEN 'Língua Portuguesa'
    WHEN contains(exam, 'Minissim') THEN 'Matemática'"""


def _classes(where: str) -> dict[str, str]:
    """Finished and enrolled students per class for the two left-joined reports."""
    return {
        "done": f"""
            SELECT college, classroom, exam, count(DISTINCT f.user_id) AS finished
            FROM finished f JOIN institution_enrollments m USING (user_id)
            JOIN chain ON chain.classroom_id = m.classroom_id AND chain.college_id = m.college_id
            WHERE {where} GROUP BY ALL""",
        "rolls": f"""
            SELECT college, classroom, count(DISTINCT user_id) AS enrolled
            FROM institution_enrollments m JOIN chain ON chain.classroom_id = m.classroom_id
            WHERE {where} GROUP BY ALL""",
        "classes": "SELECT * FROM rolls LEFT JOIN done USING (college, classroom)",
    }


def _progress(final: str = "SELECT * FROM report") -> str:
    where = f"chain.institution_id IN {_INSTITUTIONS} AND college <> 'Wiquadro'"
    return _with(
        {
            **_classes(where),
            "report": f"""
                SELECT college AS escola, classroom AS turma, {_SUBJECT.format(rest=_MINI)} AS disciplina,
                       exam AS simulado_minisimulado, coalesce(finished, 0) AS "simulados_concluídos",
                       enrolled AS matriculados_na_turma FROM classes""",
        },
        final,
    )


_LISTING = f"""SELECT college AS escola, classroom AS turma, {_SUBJECT.format(rest=_MINI_LISTING)} AS cursos,
    exam AS nome_simulado, coalesce(finished, 0) AS alunos_simulado, enrolled AS alunos_matriculados,
    {_percent("finished", "enrolled", 2)} AS taxa_participacao FROM classes"""


def _listing(final: str = "SELECT * FROM report") -> str:
    where = f"chain.institution_id IN {_INSTITUTIONS} AND lower(college) NOT IN {_EXCLUDED}"
    return _with({**_classes(where), "report": _LISTING}, final)


def _totals(by_level: bool, final: str = "SELECT * FROM report", digits: int = 1) -> str:
    """``digits`` are those of the grades after the point."""
    unit = 10**digits
    keys = "college, classroom" + (", level" if by_level else "")
    where = f"institution ILIKE '%2024%' AND lower(college) NOT IN {_EXCLUDED}"
    steps = {
        "done": f"""
            SELECT {keys}, exam, count(DISTINCT f.user_id) AS finished,
                   sum(CAST(g.average * {unit} AS BIGINT)) AS units, count(g.average) AS grades
            FROM finished f JOIN quiz_grades g ON g.user_id = f.user_id AND g.quiz_id = f.quiz_id
            JOIN institution_enrollments m ON m.user_id = f.user_id
            JOIN chain ON chain.classroom_id = m.classroom_id
            WHERE {where} AND contains(exam, 'Geral') GROUP BY ALL""",
        "rolls": f"""
            SELECT {keys}, count(DISTINCT user_id) AS enrolled
            FROM institution_enrollments m JOIN chain ON chain.classroom_id = m.classroom_id
            WHERE {where} GROUP BY ALL""",
    }
    subject = _SUBJECT.format(rest="")
    whole = f"({unit // 10} * grades)"
    mean = f"CAST((2 * units + {whole}) // (2 * {whole}) AS DOUBLE) / 10"
    share = _percent("finished", "enrolled", 1)
    if by_level:
        columns = f"""'Tauá' AS municipio, college AS escola, classroom AS turma, level AS ano,
            exam AS nome_do_simulado, {subject} AS disciplina, finished AS simulados_concluidos,
            enrolled AS matriculados_na_turma"""
    else:
        columns = f"""'Tauá' AS municipio, college, classroom AS turma, exam AS nome_simulado,
            {subject} AS cursos, finished AS total_alunos_simulado,
            enrolled AS total_alunos_matriculados"""
    steps["report"] = f"""SELECT {columns}, {mean} AS "média_notas", {share} AS taxa_participacao
        FROM done JOIN rolls USING ({keys})"""
    return _with(steps, final)


_ENROLMENT = """
    SELECT i.name AS "Nome da Instituição", e.name AS "Nome do College", count(u.id) AS "Quantidade de Alunos"
    FROM institution_enrollments m JOIN users u ON u.id = m.user_id
    JOIN institution_colleges e ON e.id = m.college_id AND e.year = 2024
    JOIN institutions i ON i.id = e.institution_id AND i.name ILIKE '%2024%' GROUP BY ALL"""


def _enrolment(final: str = "SELECT * FROM report") -> str:
    return _with({"report": _ENROLMENT}, final)


def _hierarchy() -> str:
    return _with(
        {},
        """SELECT i.holding_id, h.name AS holding_name, i.name AS institution_name, i.id AS institution_id,
                  e.name AS college_name, e.id AS college_id, k.name AS course_name, k.id AS course_id,
                  l.name AS level_name, l.id AS level_id, c.name AS classroom_name, c.id AS classroom_id
           FROM institutions i JOIN holdings h ON h.id = i.holding_id
           JOIN institution_colleges e ON e.institution_id = i.id AND e.year = 2024
           LEFT JOIN institution_courses k ON k.institution_college_id = e.id
           LEFT JOIN institution_levels l ON l.course_id = k.id
           LEFT JOIN institution_classrooms c ON c.level_id = l.id
           WHERE i.id = 15""",
    )


def _exam_students(final: str = "SELECT * FROM report") -> str:
    return _with(
        {
            "report": f"""
            SELECT CASE WHEN contains(exam, 'LP C1') THEN 'Língua Portuguesa - Curso 1'
                        WHEN contains(exam, 'MT C1') THEN 'Matemática - Curso 1'
                        WHEN contains(exam, 'LP C2') THEN 'Língua Portuguesa - Curso 2'
                        WHEN contains(exam, 'MT C2') THEN 'Matemática - Curso 2'
                        ELSE 'Outro Curso' END AS curso,
                   college AS escola, classroom AS turma, city AS cidade, exam AS simulado,
                   count(DISTINCT f.user_id) AS n_user_id
            FROM finished f JOIN institution_enrollments m ON m.user_id = f.user_id
            JOIN chain_city n ON n.classroom_id = m.classroom_id AND n.college_id = m.college_id
            WHERE (contains(exam, 'LP') OR contains(exam, 'MT')) AND year = 2024 AND city_id = 2
              AND m.institution_id IN {_INSTITUTIONS}
              AND f.quiz_id IN (SELECT quiz_id FROM institutions_quizzes WHERE institution_id IN {_INSTITUTIONS})
            GROUP BY ALL"""
        },
        final,
    )


_AGREE = """n.classroom_id = m.classroom_id AND n.college_id = m.college_id
    AND n.institution_id = m.institution_id"""


def _exam_students_holding() -> str:
    return _with(
        {},
        f"""SELECT institution AS curso, college AS escola, classroom AS turma, city AS cidade,
                   exam AS simulado, count(*) AS n_user_id
            FROM finished f JOIN institution_enrollments m ON m.user_id = f.user_id
            JOIN chain_city n ON {_AGREE} JOIN holdings h ON h.id = m.holding_id
            WHERE year = 2024 AND city_id = 2 AND h.id = 2 GROUP BY ALL""",
    )


_SCOPE = {
    "members": """SELECT i.id FROM institutions i JOIN holdings h ON h.id = i.holding_id WHERE h.id = 2""",
    "scope": """
        SELECT q.id AS quiz_id FROM institutions_learning_modules a
        JOIN learning_module_quizzes b ON b.learning_module_id = a.learning_module_id
        JOIN quizzes q ON q.id = b.quiz_id WHERE a.institution_id IN (SELECT id FROM members)
        UNION
        SELECT q.id FROM institutions_quizzes a JOIN quizzes q ON q.id = a.quiz_id
        WHERE a.institution_id IN (SELECT id FROM members)""",
}


def _scoped() -> str:
    return _with(
        _SCOPE,
        f"""SELECT institution AS curso, college AS escola, classroom AS turma, exam AS simulado,
                   count(*) AS n_user_id
            FROM finished f JOIN institution_enrollments m ON m.user_id = f.user_id
            JOIN chain n ON {_AGREE} JOIN holdings h ON h.id = m.holding_id
            WHERE year = 2023 AND h.id = 2 AND college ILIKE '%Escola Municipal%'
              AND f.quiz_id IN (SELECT quiz_id FROM scope) GROUP BY ALL""",
    )


_R3_COLUMNS = (
    "escola",
    "turma",
    "cursos",
    "nome_simulado",
    "alunos_simulado",
    "alunos_matriculados",
)
_RATE = "printf('%.2f', taxa_participacao)"
_R3_TEXTS = tuple(f"CAST({name} AS VARCHAR)" for name in _R3_COLUMNS) + (_RATE,)
_R4_COLUMNS = ("Nome da Instituição", "Nome do College", "Quantidade de Alunos")


def _facets() -> str:
    parts = [
        f"SELECT DISTINCT '{name}' AS coluna, {text} AS valor FROM report"
        for name, text in zip((*_R3_COLUMNS, "taxa_participacao"), _R3_TEXTS)
    ]
    return _listing(" UNION ALL ".join(parts))


def _row_text(texts: tuple[str, ...]) -> str:
    return "lower(concat_ws('  ', " + ", ".join(texts) + "))"


def _page(number: int, size: int) -> str:
    order = ", ".join(f"{name} NULLS LAST" for name in ("escola DESC", *_R3_COLUMNS[1:]))
    order = f"{order}, taxa_participacao"
    return _listing(f"SELECT * FROM report ORDER BY {order} LIMIT {size} OFFSET {number * size}")


def _placed(*order: str) -> str:
    """The report's rows with their place in an order, missing values last."""
    keys = ", ".join(f"{key} NULLS LAST" for key in order)
    return f"SELECT *, row_number() OVER (ORDER BY {keys}) - 1 AS position FROM report"


def _preview() -> str:
    order = ", ".join(f"{name} NULLS LAST" for name in _R3_COLUMNS)
    return _listing(f"SELECT * FROM report ORDER BY {order}, taxa_participacao LIMIT 5")


def _chart() -> str:
    return _listing(
        """SELECT escola,
                  CAST(sum(CASE WHEN cursos = 'Língua Portuguesa' THEN alunos_simulado ELSE 0 END) AS BIGINT)
                      AS "Língua Portuguesa",
                  CAST(sum(CASE WHEN cursos = 'Matemática' THEN alunos_simulado ELSE 0 END) AS BIGINT)
                      AS "Matemática",
                  CAST(sum(CASE WHEN cursos IN ('Língua Portuguesa', 'Matemática') THEN 0
                                ELSE alunos_simulado END) AS BIGINT) AS "Sem disciplina"
           FROM report GROUP BY escola"""
    )


def _csv_line(texts: tuple[str, ...]) -> str:
    def cell(text: str) -> str:
        text = f"coalesce({text}, '')"
        quoted = f"""'"' || replace({text}, '"', '""') || '"'"""
        return f"""CASE WHEN regexp_matches({text}, '[;"\\r\\n]') THEN {quoted} ELSE {text} END"""

    return "SELECT " + " || ';' || ".join(cell(text) for text in texts) + " AS linha FROM report"


_R2_TEXTS = (
    "municipio",
    """'"' || escola || '"; ' || turma""",
    "turma",
    "ano",
    "nome_do_simulado",
    "disciplina",
    "CAST(simulados_concluidos AS VARCHAR)",
    "CAST(matriculados_na_turma AS VARCHAR)",
    """printf('%.1f', "média_notas")""",
    "printf('%.1f', taxa_participacao)",
)


def _json_cell(name: str) -> str:
    return f"coalesce(CAST(to_json({name}) AS VARCHAR), 'null')"


_JSON_ROW = "'[' || " + " || ',' || ".join([*[_json_cell(name) for name in _R3_COLUMNS], _json_cell(_RATE)]) + " || ']'"


def _json() -> str:
    return _listing(f"SELECT {_JSON_ROW} AS linha FROM report")


def _framed(lines: str, frame: list[tuple[int, str]]) -> str:
    """Lines of a document: those of its parts, and one before each part."""
    edges = ", ".join(f"({part}, -1, '{text}')" for part, text in frame)
    return f"""SELECT CAST(parte AS INT) AS parte, CAST(posicao AS BIGINT) AS posicao, linha
               FROM ({lines} UNION ALL SELECT * FROM (VALUES {edges}))"""


def _json_document() -> str:
    order = ", ".join(f"{name} NULLS LAST" for name in (*_R3_COLUMNS, "taxa_participacao"))
    names = ", ".join(f'"{name}"' for name in (*_R3_COLUMNS, "taxa_participacao"))
    lines = f"""SELECT 0 AS parte, p AS posicao, CASE WHEN p = 0 THEN '' ELSE ',' END || j AS linha
                FROM (SELECT row_number() OVER (ORDER BY {order}) - 1 AS p, {_JSON_ROW} AS j FROM report)"""
    return _listing(_framed(lines, [(0, f'{{"columns":[{names}],"data":['), (1, "]}")]))


def _chart_document() -> str:
    series = ("Língua Portuguesa", "Matemática", "Sem disciplina")
    comma = "CASE WHEN p = 0 THEN '' ELSE ',' END"
    known = "'Língua Portuguesa', 'Matemática'"
    values = [f"CASE WHEN cursos = '{name}' THEN alunos_simulado ELSE 0 END" for name in series[:2]]
    values.append(f"CASE WHEN cursos IN ({known}) THEN 0 ELSE alunos_simulado END")
    sums = ", ".join(f"CAST(sum({value}) AS BIGINT) AS v{i}" for i, value in enumerate(values, 1))
    bars = f"SELECT *, row_number() OVER (ORDER BY escola NULLS LAST) - 1 AS p FROM (SELECT escola, {sums} FROM report GROUP BY escola)"
    lines = [f"SELECT 0 AS parte, p AS posicao, {comma} || {_json_cell('escola')} AS linha FROM ({bars})"]
    lines += [f"SELECT {i}, p, {comma} || v{i} FROM ({bars})" for i in (1, 2, 3)]
    frame = [(0, '{"labels":[')]
    frame += [(i, ("],\"datasets\":[" if i == 1 else "]},") + f'{{"label":"{name}","data":[') for i, name in enumerate(series, 1)]
    return _listing(_framed(" UNION ALL ".join(lines), [*frame, (4, "]}]}")]))


def _second_order() -> str:
    others = [f"{name} NULLS LAST" for name in (*_R3_COLUMNS[:5], "taxa_participacao")]
    order = ", ".join(["alunos_matriculados DESC NULLS LAST", *others])
    return _listing(f"SELECT * FROM report ORDER BY {order} LIMIT 20 OFFSET 140")


def texts(derived: bool = True) -> dict[str, str]:
    """DuckDB text per registered query.

    With ``derived`` the report tables are derived from the given tables; without,
    they are expected to exist under their own names.
    """
    tables = ",\n".join(f"{name} AS ({text})" for name, text in _TABLES.items()) + ",\n"
    found = {name: f"WITH {tables if derived else ''}{text}" for name, text in _reports().items()}
    if derived:
        old, new = "CAST(max(l_quantity) AS DECIMAL(5, 1))", "CAST(max(l_quantity) AS DECIMAL(20, 7)) + 0.0499999"
        fine = _totals(True, digits=7)
        found["r2_exact_grades"] = f"WITH {tables.replace(old, new)}{fine}"
    return found


def _reports() -> dict[str, str]:
    words = _row_text(_R3_TEXTS)
    return {
        "r1_progress_by_exam": _progress(),
        "r2_class_totals": _totals(True),
        "r2_class_totals_no_level": _totals(False),
        "r3_listing_rate": _listing(),
        "r4_enrolment_by_college": _enrolment(),
        "r5_hierarchy_listing": _hierarchy(),
        "r6_students_by_exam": _exam_students(),
        "r6_students_by_exam_holding": _exam_students_holding(),
        "r7_scoped_exams": _scoped(),
        "exam_scope_union": _with(_SCOPE, "SELECT quiz_id FROM scope"),
        "filter_ilike": _totals(
            True, "SELECT * FROM report WHERE escola ILIKE 'escola%' AND nome_do_simulado ILIKE '%geral lp%'"
        ),
        "filter_eq": _listing("SELECT * FROM report WHERE cursos = 'Matemática' AND turma = 'Turma A'"),
        "grid_search": _listing(
            f"SELECT * FROM report WHERE contains({words}, 'brand#1') AND contains({words}, 'municipal')"
        ),
        "grid_first_column_search": _enrolment(
            """SELECT * FROM report WHERE contains(upper(coalesce("Nome da Instituição", '')), 'NATION_1')"""
        ),
        "grid_multiselect": _listing(
            """SELECT * FROM report WHERE cursos IN ('Matemática', 'Língua Portuguesa') AND turma IN ('Turma B')"""
        ),
        "grid_facets": _facets(),
        "grid_multiselect_contains": _listing(
            """SELECT * FROM report WHERE (contains(lower(cursos), 'mat') OR contains(lower(cursos), 'xyz'))
               AND contains(lower(turma), 'b')"""
        ),
        "grid_search_phrase": _listing(
            f"SELECT * FROM report WHERE contains({words}, 'turma a') AND contains({words}, '.5')"
        ),
        "grid_sort": _enrolment(
            _placed('"Quantidade de Alunos" DESC', '"Nome da Instituição"', '"Nome do College"')
        ),
        "grid_sort_columns": _listing(
            _placed("turma DESC", "alunos_simulado", "escola", "cursos", "nome_simulado",
                    "alunos_matriculados", "taxa_participacao")
        ),
        "order_r1": _progress(
            _placed("escola", "turma", "disciplina", "simulado_minisimulado", '"simulados_concluídos"',
                    "matriculados_na_turma")
        ),
        "order_r2": _totals(
            True,
            _placed("escola", "turma", "nome_do_simulado", "municipio", "ano", "disciplina",
                    "simulados_concluidos", "matriculados_na_turma", '"média_notas"', "taxa_participacao"),
        ),
        "order_r3": _listing(_placed(*_R3_COLUMNS, "taxa_participacao")),
        "order_r6": _exam_students(
            _placed("curso", "escola", "turma", "cidade", "simulado", "n_user_id")
        ),
        "grid_page": _page(2, 25),
        "grid_page_deep": _page(60, 10),
        "grid_counts": _listing(
            f"SELECT count(*) AS total, count(*) FILTER (contains({words}, 'minisim')) AS filtered FROM report"
        ),
        "preview": _preview(),
        "chart_series": _chart(),
        "export_csv_rows": _enrolment(_csv_line(tuple(f'CAST("{name}" AS VARCHAR)' for name in _R4_COLUMNS))),
        "export_csv_listing": _listing(_csv_line(_R3_TEXTS)),
        "export_csv_totals": _totals(True, _csv_line(_R2_TEXTS)),
        "export_json_rows": _json(),
        "export_json_document": _json_document(),
        "chart_document": _chart_document(),
        # Case and accents count only between names that are equal without them.
        "order_collated": _listing(
            _placed("lower(strip_accents(nome_simulado))", "nome_simulado", "escola", "turma", "cursos",
                    "alunos_simulado", "alunos_matriculados", "taxa_participacao")
        ),
        "grid_second_order": _second_order(),
        "grid_multiselect_stored": _listing(
            """SELECT * FROM report WHERE nome_simulado IN ('Brand#1 MT C1', 'Brand#12 Minissim') AND turma = 'Turma B'"""
        ),
        "r2_class_totals_laid_out": _totals(True),
        "r1_progress_laid_out": _progress(),
        "r1_progress_kept": _progress(),
    }
