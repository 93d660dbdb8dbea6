"""Rubrics: general criteria for every question, templates by question type, aliases and keyword rules that lead to a template.

A rubric is a file of configuration, so it is read on the driver; what is applied to questions is a Column or a join with one row a template.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.operators.joins import route

GENERAL = ""


@dataclass(frozen=True)
class Rubric:
    """general and templates: rubric_criteria (a list of maps with name and descriptions), scoring_rule, sufficient_threshold."""

    general: dict
    templates: dict[str, dict]
    aliases: dict[str, str]
    rules: list[tuple[list[str], str]]

    @classmethod
    def of(cls, data: dict) -> Rubric:
        general = data.get("general") or {}
        if not general.get("rubric_criteria"):
            raise ValueError("a rubric needs general.rubric_criteria")
        words = lambda k: [k] if isinstance(k, str) else list(k or [])
        rules = [(words(r.get("keywords")), str(r.get("qtype", ""))) for r in data.get("keyword_rules") or []]
        return cls(general, dict(data.get("templates") or {}), dict(data.get("type_aliases") or {}), rules)

    @classmethod
    def read(cls, path: str) -> Rubric:
        """A JSON or, where a reader for it is installed, YAML file on the driver."""
        with open(path, encoding="utf-8") as f:
            if path.endswith(".json"):
                return cls.of(json.load(f))
            import yaml

            return cls.of(yaml.safe_load(f))

    def key(self, question: Column, task: Column) -> Column:
        """The template of a question: the first keyword rule that leads to one, else its type's alias, else GENERAL."""
        alias = F.lit(GENERAL)
        for kind, template in self.aliases.items():
            if template in self.templates:
                alias = F.when(task == kind, template).otherwise(alias)
        return route(F.coalesce(question, F.lit("")), [(w, k) for w, k in self.rules if k in self.templates], alias)

    def combined(self, template: str) -> tuple[list[str], str, float]:
        """(names of the criteria, scoring rule, threshold) under a template."""
        own = self.templates.get(template) or {}
        names = [c["name"] for c in [*self.general["rubric_criteria"], *(own.get("rubric_criteria") or [])]]
        rest = [own.get(k, self.general.get(k, d)) for k, d in (("scoring_rule", "average"), ("sufficient_threshold", 0.75))]
        return names, str(rest[0]), float(rest[1])

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a template, and one for GENERAL."""
        return spark.createDataFrame([(k, *self.combined(k)) for k in [GENERAL, *self.templates]], "template string, criteria array<string>, scoring_rule string, threshold double")

    def applied(self, questions: DataFrame, question: str, task: str) -> DataFrame:
        """questions with template, criteria, scoring_rule and threshold; the table has as many rows as the file has templates."""
        keyed = questions.withColumn("template", self.key(F.col(question), F.col(task)))
        return keyed.join(F.broadcast(self.table(questions.sparkSession)), "template")
