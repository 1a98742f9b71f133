"""Column builders: values as text, numbers, times and addresses; word matching; formatting."""
