"""A small movie database of the usual 21 tables, and queries of the shapes that are asked of it, both made by rule."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

# Tables with their columns (i: integer, s: string; "?" where null occurs), as the public schema has them.
TABLES = {
    "aka_name": "id:i person_id:i name:s imdb_index:s? md5sum:s?",
    "aka_title": "id:i movie_id:i title:s kind_id:i production_year:i? note:s?",
    "cast_info": "id:i person_id:i movie_id:i person_role_id:i? note:s? nr_order:i? role_id:i",
    "char_name": "id:i name:s imdb_index:s?",
    "comp_cast_type": "id:i kind:s",
    "company_name": "id:i name:s country_code:s?",
    "company_type": "id:i kind:s",
    "complete_cast": "id:i movie_id:i? subject_id:i status_id:i",
    "info_type": "id:i info:s",
    "keyword": "id:i keyword:s phonetic_code:s?",
    "kind_type": "id:i kind:s",
    "link_type": "id:i link:s",
    "movie_companies": "id:i movie_id:i company_id:i company_type_id:i note:s?",
    "movie_info": "id:i movie_id:i info_type_id:i info:s note:s?",
    "movie_info_idx": "id:i movie_id:i info_type_id:i info:s note:s?",
    "movie_keyword": "id:i movie_id:i keyword_id:i",
    "movie_link": "id:i movie_id:i linked_movie_id:i link_type_id:i",
    "name": "id:i name:s gender:s? imdb_index:s?",
    "person_info": "id:i person_id:i info_type_id:i info:s note:s?",
    "role_type": "id:i role:s",
    "title": "id:i title:s kind_id:i production_year:i? episode_nr:i? series_years:s?",
}
# Child column, parent table.
REFERENCES = {
    "aka_name.person_id": "name", "aka_title.movie_id": "title", "aka_title.kind_id": "kind_type", "cast_info.person_id": "name", "cast_info.movie_id": "title",
    "cast_info.person_role_id": "char_name", "cast_info.role_id": "role_type", "complete_cast.movie_id": "title", "complete_cast.subject_id": "comp_cast_type",
    "complete_cast.status_id": "comp_cast_type", "movie_companies.movie_id": "title", "movie_companies.company_id": "company_name", "movie_companies.company_type_id": "company_type",
    "movie_info.movie_id": "title", "movie_info.info_type_id": "info_type", "movie_info_idx.movie_id": "title", "movie_info_idx.info_type_id": "info_type",
    "movie_keyword.movie_id": "title", "movie_keyword.keyword_id": "keyword", "movie_link.movie_id": "title", "movie_link.linked_movie_id": "title", "movie_link.link_type_id": "link_type",
    "person_info.person_id": "name", "person_info.info_type_id": "info_type", "title.kind_id": "kind_type",
}
KEYS = {t: {"id"} for t in TABLES}
#: Relations in a query, and how many queries have so many.
RELATIONS = {4: 3, 5: 20, 6: 2, 7: 16, 8: 21, 9: 14, 10: 7, 11: 10, 12: 11, 14: 6, 17: 3}
SMALL = {"comp_cast_type": 4, "company_type": 4, "info_type": 20, "kind_type": 7, "link_type": 12, "role_type": 11, "title": 60, "name": 50, "char_name": 40, "keyword": 40, "company_name": 40}


def columns(table):
    return [(n, k[0], k.endswith("?")) for n, k in (c.split(":") for c in TABLES[table].split())]


def write(folder, seed=1):
    """Each table as Parquet: 120 rows where SMALL says nothing else."""
    r = random.Random(seed)
    sizes = {t: SMALL.get(t, 120) for t in TABLES}
    for t in TABLES:
        data = {}
        for name, kind, nulls in columns(t):
            parent = REFERENCES.get(f"{t}.{name}")
            if name == "id":
                values = list(range(1, sizes[t] + 1))
            elif parent:
                values = [r.randint(1, sizes[parent]) for _ in range(sizes[t])]
            elif kind == "i":
                values = [r.randint(1950, 2015) if "year" in name else r.randint(1, 40) for _ in range(sizes[t])]
            else:
                values = [f"{r.choice(['new', 'old', '(voice)', 'B', 'the'])} {name} {r.randint(1, 6)}" for _ in range(sizes[t])]
            if nulls:
                values = [None if r.random() < 0.2 else v for v in values]
            data[name] = pa.array(values, pa.int32() if kind == "i" else pa.string())
        pq.write_table(pa.table(data), f"{folder}/{t}.parquet")


def _predicate(r, alias, table):
    name, kind, nulls = r.choice([c for c in columns(table) if c[0] != "id" and f"{table}.{c[0]}" not in REFERENCES])
    c = f"{alias}.{name}"
    if kind == "i":
        low = r.randint(1950, 1990) if "year" in name else r.randint(1, 20)
        return r.choice([f"{c} > {low}", f"{c} BETWEEN {low} AND {low + 20}", f"{c} IN ({low}, {low + 3}, {low + 5}, {low + 7})", f"{c} >= {low}", f"{c} != {low}"])
    made = [f"{c} LIKE '%{name} %'", f"({c} LIKE 'new%' OR {c} LIKE '%1' OR {c} = 'old {name} 2')", f"{c} NOT LIKE '%(voice)%'", f"{c} != 'B {name} 3'", f"{c} IN ('new {name} 1', 'old {name} 2', 'the {name} 3', 'B {name} 4')", f"{c} < 'z'"]
    return r.choice([*made, f"{c} IS NOT NULL", f"({c} IS NULL OR {c} LIKE '%2%')"] if nulls else made)


def query(number):
    """The SQL of the query with this number, from 0: MIN columns of relations joined along references, tables repeated."""
    sizes = [n for n, times in RELATIONS.items() for _ in range(times)]
    r, size = random.Random(1000 + number), sizes[number]
    children = {}
    for c, parent in REFERENCES.items():
        children.setdefault(parent, []).append(c.split("."))
    tables, joins, predicates = {"t": "title"}, [], []
    movies, taken = ["t"], set()
    while len(tables) < size:
        alias = r.choice(list(tables))
        table = tables[alias]
        up = [(c.split(".")[1], p) for c, p in REFERENCES.items() if c.split(".")[0] == table and (alias, c) not in taken]
        down = [x for x in children.get(table, []) if table in ("title", "name")]
        new = f"x{len(tables)}"
        if up and (not down or r.random() < 0.55):
            column, parent = r.choice(up)
            taken.add((alias, f"{table}.{column}"))
            if parent == "title" and r.random() < 0.7:
                joins.append(f"{alias}.{column} = {r.choice(movies)}.id")
                continue
            tables[new] = parent
            joins.append(f"{new}.id = {alias}.{column}" if r.random() < 0.5 else f"{alias}.{column} = {new}.id")
        elif down:
            child, column = r.choice(down)
            tables[new] = child
            taken.add((new, f"{child}.{column}"))
            joins.append(f"{alias}.id = {new}.{column}")
            near = [a for a, t in tables.items() if a != new and f"{t}.movie_id" in REFERENCES and (a, f"{t}.movie_id") in taken]
            if column == "movie_id" and near and r.random() < 0.4:  # what the closure gives anyway
                pick = next((a for a in near if f"{alias}.id = {a}.movie_id" in joins), None)
                if pick:
                    joins.append(f"{pick}.movie_id = {new}.movie_id")
    for alias, table in tables.items():
        if any(c[0] != "id" and f"{table}.{c[0]}" not in REFERENCES for c in columns(table)) and r.random() < 0.55:
            predicates.append(_predicate(r, alias, table))
    outs = r.sample([(a, c[0]) for a, t in tables.items() for c in columns(t) if c[0] != "id"], r.randint(1, 3))
    select = ", ".join(f"MIN({a}.{c}) AS o{i}" for i, (a, c) in enumerate(outs))
    return f"SELECT {select} FROM {', '.join(f'{t} AS {a}' for a, t in tables.items())} WHERE {' AND '.join([*predicates, *joins])}"
