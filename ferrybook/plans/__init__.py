"""The named reports and the SQL that says what each must return."""
