"""The journal registry and lookups on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, issn string, field string, publisher string"
FIELDS = ["accounting", "finance", "economics", "management"]

# The registered journals as (name, ISSN, field, publisher).
JOURNALS = [
    ("The Accounting Review", "0001-4826", "accounting", "AAA"),
    ("Journal of Accounting and Economics", "0165-4101", "accounting", "Elsevier"),
    ("Journal of Accounting Research", "0021-8456", "accounting", "Wiley"),
    ("Contemporary Accounting Research", "0823-9150", "accounting", "Wiley"),
    ("Accounting, Organizations and Society", "0361-3682", "accounting", "Elsevier"),
    ("Review of Accounting Studies", "1380-6653", "accounting", "Springer"),
    ("European Accounting Review", "0963-8180", "accounting", "Taylor & Francis"),
    ("Auditing: A Journal of Practice & Theory", "0278-0380", "accounting", "AAA"),
    ("Journal of Finance", "0022-1082", "finance", "Wiley"),
    ("Journal of Financial Economics", "0304-405X", "finance", "Elsevier"),
    ("Review of Financial Studies", "0893-9454", "finance", "Oxford"),
    ("Journal of Financial and Quantitative Analysis", "0022-1090", "finance", "Cambridge"),
    ("Financial Management", "0046-3892", "finance", "Wiley"),
    ("Management Science", "0025-1909", "finance", "INFORMS"),
    ("Journal of Corporate Finance", "0929-1199", "finance", "Elsevier"),
    ("Annual Review of Financial Economics", "1941-1367", "finance", "Annual Reviews"),
    ("American Economic Review", "0002-8282", "economics", "AEA"),
    ("Econometrica", "0012-9682", "economics", "Wiley"),
    ("Quarterly Journal of Economics", "0033-5533", "economics", "Oxford"),
    ("Journal of Political Economy", "0022-3808", "economics", "Chicago"),
    ("Review of Economic Studies", "0034-6527", "economics", "Oxford"),
    ("Journal of Economic Literature", "0022-0515", "economics", "AEA"),
    ("Journal of Economic Perspectives", "0895-3309", "economics", "AEA"),
    ("Journal of Labor Economics", "0734-306X", "economics", "Chicago"),
    ("Journal of Human Resources", "0022-166X", "economics", "Wisconsin"),
    ("Journal of Law and Economics", "0022-2186", "economics", "Chicago"),
    ("Review of Economics and Statistics", "0034-6535", "economics", "MIT Press"),
    ("Annual Review of Economics", "1941-1383", "economics", "Annual Reviews"),
    ("Journal of Health Economics", "0167-6296", "economics", "Elsevier"),
    ("Human Resource Management", "0090-4848", "management", "Wiley"),
    ("Academy of Management Annals", "1941-6520", "management", "AOM"),
    ("ACADEMY OF MANAGEMENT JOURNAL", "0001-4273", "management", "AOM"),
    ("ACADEMY OF MANAGEMENT REVIEW", "0363-7425", "management", "AOM"),
    ("ADMINISTRATIVE SCIENCE QUARTERLY", "0001-8392", "management", "SAGE"),
    ("JOURNAL OF MANAGEMENT", "0149-2063", "management", "SAGE"),
]


def registry_rows() -> list[tuple[str, str, str, str]]:
    return list(JOURNALS)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(registry_rows(), SCHEMA)


def journals_by_field(journals: DataFrame, field: str) -> DataFrame:
    """Journals of one field, any case, or of all; an unknown field is an error."""
    wanted = field.lower()
    if wanted == "all":
        return journals
    if wanted not in FIELDS:
        raise ValueError(f"unknown field: {field}; one of {', '.join(FIELDS)}, all")
    return journals.filter(F.col("field") == wanted)
