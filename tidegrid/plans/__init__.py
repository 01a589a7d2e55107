"""Registered queries: operators applied to whole tables, each with its SQL counterpart where SQL has one."""
