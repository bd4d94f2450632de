"""All queries of this subpackage, the corpus pipeline among them."""

import corpus_pipeline
from panelfolio.llm.queries import REGISTRY as OPERATORS
from panelfolio.llm.queries import STATEMENTS as OPERATOR_STATEMENTS

REGISTRY = {**OPERATORS, "pipeline": corpus_pipeline.run}
STATEMENTS = OPERATOR_STATEMENTS if corpus_pipeline.ORACLE_SQL is None else {**OPERATOR_STATEMENTS, "pipeline": corpus_pipeline.ORACLE_SQL}
