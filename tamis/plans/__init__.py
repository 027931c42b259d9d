from .checks import Check, compile_rules, rule_errors
from .conditions import condition_column
from .rules import (DEFAULT_RULES, DELIVERY_RULES, Rule, load_rules, merge_rules, number_generated, parse_rules,
                    relations, rules_df, rules_from_df)

__all__ = ["Check", "compile_rules", "condition_column", "DEFAULT_RULES", "DELIVERY_RULES", "Rule", "load_rules",
           "merge_rules", "number_generated", "parse_rules", "relations", "rule_errors", "rules_df", "rules_from_df"]
