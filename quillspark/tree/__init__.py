"""Documents as trees inside one task: XPath, rules, rendering, pages and passages of a single document."""
