"""Logical plans: what each registered query computes, and the SQL that gives the same rows."""
