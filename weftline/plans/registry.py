"""All queries outside the llm subpackage."""

from weftline.plans import problems, reference

QUERIES = {**problems.QUERIES, **reference.QUERIES}
SQL = {**problems.SQL, **reference.SQL}
