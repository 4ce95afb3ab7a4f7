"""The registered queries: each operator applied to whole tables, with the SQL that it is compared with."""
