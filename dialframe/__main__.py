from dialframe.cli import main

main()
